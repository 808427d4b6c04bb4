"""Keyed upserts, differences and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.text import non_blank, norm_key, normalized


def ordered_upsert(df: DataFrame, keys: list[str], order: str | Column, fields: list[str], skip_blank: bool = True) -> DataFrame:
    """One row for each key: of every field the last value (the last non-blank one), and `seen`, where the key came first."""
    order = F.col(order) if isinstance(order, str) else order
    last = []
    for f in fields:
        v = F.col(f)
        there = non_blank(v).isNotNull() if skip_blank and dict(df.dtypes)[f] == "string" else v.isNotNull() if skip_blank else F.lit(True)
        last.append(F.max_by(v, F.when(there, order)).alias(f))
    return df.groupBy(*keys).agg(F.min(order).alias("seen"), *last)


def merge_variables(df: DataFrame) -> DataFrame:
    """predicate, name, ord, type, description, value_options: later rows overwrite every field that they carry."""
    named = df.withColumn("name", normalized("name")).where("name <> ''")
    return ordered_upsert(named, ["predicate", "name"], "ord", ["type", "description", "value_options"], skip_blank=False)


def merge_predicates(predicates: DataFrame, variables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Predicates by trimmed name, in the order of their first row; and their variables.

    predicates: name, ord, description, evidence. variables: predicate, pred_ord, ord, name, type, description,
    value_options. A predicate that came once keeps its variables as they are; one that came again has them merged.
    """
    p = predicates.withColumn("name", normalized("name")).where("name <> ''")
    merged = ordered_upsert(p, ["name"], "ord", ["description", "evidence"])
    times = p.groupBy(F.col("name").alias("predicate")).agg(F.count("*").alias("_times"))
    v = variables.withColumn("predicate", normalized("predicate")).join(times, "predicate")
    once = v.where("_times = 1").select("predicate", "name", F.struct("pred_ord", "ord").alias("seen"), "type", "description", "value_options")
    again = v.where("_times > 1").withColumn("name", normalized("name")).where("name <> ''")
    again = ordered_upsert(again, ["predicate", "name"], F.struct("pred_ord", "ord"), ["type", "description", "value_options"], skip_blank=False)
    return merged, once.unionByName(again)


def candidates(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First candidate of each (predicate, variable) regardless of case and punctuation, with chunks and paths of all; and the duplicates."""
    keyed = df.withColumn("key_p", norm_key("predicate")).withColumn("key_v", norm_key("variable"))
    first = [F.min_by(c, "ord").alias(c) for c in ("predicate", "variable", "type", "description")]
    chunks = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "chunk_id"))), lambda x: x["chunk_id"])).alias("chunks")
    kept = keyed.groupBy("key_p", "key_v").agg(F.min("ord").alias("ord"), *first, chunks, F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("key_p", "key_v").orderBy("ord"))
    return kept, keyed.withColumn("nth", place).where("nth > 1")


def regrouped(kept: DataFrame) -> DataFrame:
    """Variables of each predicate as first spelt."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "variable"))), lambda x: x["variable"])
    return kept.groupBy("predicate").agg(F.min("ord").alias("ord"), listed.alias("variables"))


def running_distinct(df: DataFrame, chunk: str, keys: list[str]) -> DataFrame:
    """chunk, n_new, before, after: how many distinct keys there were before and after each chunk."""
    firsts = df.groupBy(*keys).agg(F.min(chunk).alias(chunk))
    every = df.select(chunk).distinct().join(firsts.groupBy(chunk).agg(F.count("*").alias("n_new")), chunk, "left").fillna(0, ["n_new"])
    upto = F.sum("n_new").over(Window.orderBy(chunk).rowsBetween(Window.unboundedPreceding, 0))  # a row for each chunk
    return every.withColumn("after", upto).withColumn("before", F.col("after") - F.col("n_new"))


def key_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys (lower-cased), side: FN if only left has them, FP if only right has, else TP."""
    low = lambda df, flag: df.select(*[F.lower(F.trim(k)).alias(k) for k in keys]).distinct().withColumn(flag, F.lit(True))
    both = low(left, "_l").join(low(right, "_r"), keys, "full_outer")
    return both.select(*keys, F.when(F.col("_r").isNull(), "FN").when(F.col("_l").isNull(), "FP").otherwise("TP").alias("side"))


def drop_verdicts(verdicts: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys with a drop verdict on a row that exists; a keep verdict never outweighs one."""
    return verdicts.where(F.lower(F.trim("verdict")) == "drop").join(rows.select(*keys).distinct(), keys, "left_semi").select(*keys).distinct()


def monotone_decrease(rows: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a valid drop verdict; a missing verdict keeps."""
    return rows.join(drop_verdicts(verdicts, rows, keys), keys, "left_anti")


def verdict_counts(verdicts: DataFrame, rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    known = rows.select(*keys).distinct().withColumn("_known", F.lit(True))
    v = verdicts.join(known, keys, "left").withColumn("_drop", F.lower(F.trim("verdict")) == "drop")
    valid = F.col("_known").isNotNull()
    return v.groupBy(*by).agg(F.count_if(valid & F.col("_drop")).alias("n_drop"), F.count_if(valid & ~F.col("_drop")).alias("n_keep"), F.count_if(~valid).alias("n_invalid"))


def usage_rollup(df: DataFrame, keys: list[str], prompt: str, cached: str, sums: list[str]) -> DataFrame:
    """Sums, number of requests and the share of the prompt that was cached (0 without a prompt)."""
    rate = F.coalesce(F.try_divide(F.sum(cached), F.sum(prompt)), F.lit(0.0))
    return df.groupBy(*keys).agg(F.count("*").alias("n_requests"), *[F.sum(s).alias(s) for s in sums], rate.alias("cache_hit_rate"))


def reusable(planned: DataFrame, earlier: DataFrame) -> DataFrame:
    """Chunks with the output of an earlier run of the same id and cache key that did not fail."""
    ok = earlier.where("not failed and n_definitions > 0").groupBy("chunk_id", "cache_key").agg(F.max_by("output", "ord").alias("output"))
    return planned.join(ok, ["chunk_id", "cache_key"], "left").withColumn("reused", F.col("output").isNotNull())
