"""Ranked deduplication: the best row of each group, and pipelines of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.classify import is_noise_code, is_package_path
from weft.functions.text import normalized


def top1(df: DataFrame, keys: list[str | Column], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in the order. Spark keeps n rows of each key before the shuffle already."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def ranks(value: Column, names: list[str], other: int | None = None) -> Column:
    """Place of a value in a list of names."""
    out = F.lit(len(names) if other is None else other)
    for i, n in reversed(list(enumerate(names))):
        out = F.when(value == n, F.lit(i)).otherwise(out)
    return out


def instance_dedup(df: DataFrame) -> DataFrame:
    """Occurrences of the same resource, place, code, handle and owner: that of the smallest node."""
    return top1(df, ["resource_id", "location", "code", "handle_name", "handle_owner_node_id"], [F.col("node_id")])


def canonical_handles(df: DataFrame, java: bool = False) -> DataFrame:
    """One occurrence for each handle of a resource.

    Columns: resource_id, binding_class, binding_field, handle_name, handle_owner_node_id, node_id, location,
    occurrence_role, code. Multi-line code that names neither resource nor field on its first line goes.
    """
    code, handle = normalized("code"), normalized("handle_name")
    name = F.substring_index("resource_id", ".", -1)
    field = normalized("binding_field")
    first = F.coalesce(F.get(F.filter(F.transform(F.split(code, "\n"), F.trim), lambda x: x != ""), F.lit(0)), F.lit(""))
    mentions = first.contains(name) | ((field != "") & first.contains(field))
    kept = df.where(~code.contains("\n") | mentions)
    identity = (
        F.when(F.col("handle_owner_node_id").isNotNull(), F.concat(F.lit("node:"), F.col("handle_owner_node_id")))
        .when(handle != "", F.concat_ws(":", F.lit("name"), normalized("binding_class"), handle))
        .otherwise(F.concat(F.lit("inline:"), F.col("node_id")))
    )
    starts = [F.concat(F.lit(p), handle, F.lit(s)) for p, s in (("", " ="), ("this.", " ="))] if java else [F.concat(F.lit(p), handle, F.lit(s)) for p, s in (("val ", ""), ("var ", ""), ("", " ="), ("", " by "))]
    owns = code.startswith(starts[0])
    for s in starts[1:]:
        owns = owns | code.startswith(s)
    owns = owns | (code.contains(F.concat(F.lit(" "), handle, F.lit(" ="))) if java else code == F.concat(F.lit("binding."), field))
    owner_rank = F.when((handle != "") & owns, 0).when((handle != "") & code.contains(handle), 1).otherwise(2)
    looks = code.rlike("findViewById|requireViewById|binding\\." if java else "findViewById|binding\\.")
    order = [F.when(F.col("occurrence_role") == "HANDLE", 0).otherwise(1), owner_rank, F.when(looks, 0).otherwise(1), F.length(code), F.col("node_id")]
    keyed = kept.withColumn("_identity", identity).withColumn("_place", F.when(handle == "", F.col("location")))
    return top1(keyed, ["resource_id", "_identity", "_place"], order).drop("_identity", "_place")


USAGE_TYPES = ["CHAINED_CALL", "DELEGATE", "ASSIGN", "RETURN_SCOPE"]
KINDS = ["LISTENER", "DELEGATE", "SETTER", "GETTER", "OTHER"]


def longest_usage(df: DataFrame) -> DataFrame:
    """Usages of one place, node, kind and method: that with the longest code."""
    return top1(df, ["location", "node_id", "kind", "method"], [F.desc(F.length("code")), F.col("code"), F.col("ord")])


def node_conflicts(df: DataFrame) -> DataFrame:
    """Of the usages at one node, that of the strongest type; nodes that aren't known stay."""
    known = top1(df.where("node_id > 0"), ["node_id"], [ranks(F.col("usage_type"), USAGE_TYPES), F.desc(F.length(F.trim("code"))), F.col("ord")])
    return known.unionByName(df.where("node_id <= 0 or node_id is null"))


def cross_anchor(df: DataFrame) -> DataFrame:
    """Noise out, the best usage of each node, then of each line's code, then what longer code contains goes."""
    order = [ranks(F.col("kind"), KINDS), F.desc(F.length("code")), F.col("report"), F.col("ord")]
    clean = df.where(~is_noise_code("code") & ~is_package_path("code"))
    by_node = top1(clean, ["resource_id", "node_id"], order)
    by_line = top1(by_node, ["resource_id", "file", "line", "code"], order)
    return not_contained(by_line, ["resource_id", "file", "line"], "code")


def java_usages(df: DataFrame) -> DataFrame:
    return top1(df, ["node_id", "file", "line"], [ranks(F.col("kind"), KINDS), F.desc(F.length("code")), F.col("ord")])


def grams(text: Column, size: int) -> Column:
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substr(text, i, F.lit(size)))))


def containing(df: DataFrame, keys: list[str], text: str, size: int = 4) -> DataFrame:
    """keys, short, long: distinct texts that properly lie in a longer one of the same keys.

    Whatever contains a text has all its grams, so the short side sends one gram (that of the largest hash) to an
    equi-join with all grams of the long side; texts shorter than a gram are their own gram.
    """
    texts = df.select(*keys, F.col(text).alias("t")).where("length(t) > 0").distinct()
    parts = []
    for n in range(1, size + 1):
        short = texts.where(F.length("t") >= n if n == size else F.length("t") == n)
        one = F.array_max(F.transform(grams(F.col("t"), n), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g"))))["g"]
        short = short.select(*keys, F.col("t").alias("short"), one.alias("gram"))
        long = texts.where(F.length("t") > n).select(*keys, F.col("t").alias("long"), F.explode(grams(F.col("t"), n)).alias("gram"))
        parts.append(short.join(long, [*keys, "gram"]).where("length(long) > length(short) and contains(long, short)"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*keys, "short", "long")


def not_contained(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Rows whose text does not lie in a longer text of the same keys."""
    inside = containing(df, keys, text).select(*keys, F.col("short").alias(text)).distinct()
    return df.join(inside, [*keys, text], "left_anti")
