"""Text of evidence: methods, types, control flow, questions and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.text import normalized, numbered

from .evidence import ordered


def joined(value: Column, order: Column | str, by: str = "\n\n") -> Column:
    return F.array_join(ordered(value, order, distinct=False), by)


def method_blobs(methods: DataFrame, types: DataFrame, mode: str = "v3") -> DataFrame:
    """page, blob. v3: methods and types; v4 and critic add which resources lead to a method, critic a header.

    methods: page, ord, method, source_code, resource_ids. types: page, ord, type_full_name, body.
    """
    body = F.concat_ws("\n", F.concat(F.lit("## "), F.col("method")), normalized("source_code"))
    if mode != "v3":
        body = F.concat_ws("\n", body, F.concat(F.lit("resources: "), F.array_join("resource_ids", ", ")))
    m = methods.groupBy("page").agg(joined(body, "ord").alias("_m"))
    t = types.groupBy("page").agg(joined(F.concat_ws("\n", F.concat(F.lit("### "), F.col("type_full_name")), normalized("body")), "ord").alias("_t"))
    head = F.lit("# Evidence for the critic") if mode == "critic" else F.lit(None).cast("string")
    return m.join(t, "page", "left").select("page", F.concat_ws("\n\n", head, "_m", "_t").alias("blob"))


def cfg_text(report: DataFrame, blocks: DataFrame) -> DataFrame:
    """method, text: one line of counts and a line for each block."""
    lines = blocks.groupBy("method").agg(joined(F.format_string("[B%d] lines %d-%d, %d nodes", "leader", "first_line", "last_line", "n_nodes"), F.col("first_line"), "\n").alias("_b"))
    head = F.format_string("branches=%d · exits<=%d · loops=%s", "n_branches", "n_exits", F.col("has_loop").cast("string"))
    return report.join(lines, "method", "left").select("method", F.concat_ws("\n", head, "_b").alias("text"))


def candidates_json(variables: DataFrame) -> DataFrame:
    """page, json: predicates and variables with temporary ids. variables: page, p, v (places from 1), predicate, name, type, description."""
    v = F.struct(numbered("V", "v").alias("variable_id"), "name", "type", "description")
    ps = variables.groupBy("page", "p", "predicate").agg(ordered(v, "v", distinct=False).alias("variables"))
    p = F.struct(numbered("P", "p").alias("predicate_id"), F.col("predicate").alias("name"), "variables")
    return ps.groupBy("page").agg(F.to_json(ordered(p, "p", distinct=False)).alias("json"))


def difference_question(diff: DataFrame, keys: list[str]) -> DataFrame:
    """text: what is missing, then what is too much; no row if there is nothing to ask."""
    rows = diff.where("side in ('FN', 'FP')").withColumn("_line", F.concat_ws(".", *keys))
    parts = rows.groupBy("side").agg(F.concat_ws("\n", F.when(F.first("side") == "FN", "Missing:").otherwise("Unexpected:"), F.array_join(F.sort_array(F.collect_set("_line")), "\n")).alias("t"))
    return parts.agg(F.array_join(ordered("t", "side", distinct=False), "\n\n").alias("text")).where("text <> ''")


def filled(template: str, **values: Column) -> Column:
    """The template with {name} replaced; null becomes empty."""
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), F.coalesce(v.cast("string"), F.lit("")))
    return out


def limited(values: Column, most: int = 12) -> Column:
    """Sorted distinct values, the first ones and how many more."""
    v = F.array_sort(F.array_distinct(values))
    more = F.when(F.size(v) > most, F.concat(F.lit(" (+"), F.size(v) - most, F.lit(" more)"))).otherwise("")
    return F.concat(F.array_join(F.slice(v, 1, most), ", "), more)
