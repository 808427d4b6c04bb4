"""JSON documents read as VARIANT: the schema is asked of each document when it is read, and what can't be read is kept apart.

Defined cases: a null text is missing; a text that isn't JSON, or an object that names a key twice, is malformed; a value of another
kind than asked for is null (a number asked for as text is its text); elements and members that aren't objects are passed over where
objects are asked for; the members of an object come in the order of their keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(files: DataFrame) -> DataFrame:
    """files (path, text) with doc (VARIANT) and problem: missing, malformed or null."""
    rows = files.withColumn("doc", F.try_parse_json("text"))
    return rows.withColumn("problem", F.when(F.col("text").isNull(), "missing").when(F.col("doc").isNull(), "malformed"))


def field(doc, path: str, kind: str = "string") -> Column:
    """The value at a path of a variant, null if it is of another kind."""
    return F.try_variant_get(F.col(doc) if isinstance(doc, str) else doc, path, kind)


def is_object(doc) -> Column:
    return F.startswith(F.schema_of_variant(doc), F.lit("OBJECT"))


def is_array(doc) -> Column:
    return F.startswith(F.schema_of_variant(doc), F.lit("ARRAY"))


def objects(docs: DataFrame, path: str = "$", doc: str = "doc") -> DataFrame:
    """docs with ord and item (VARIANT): the objects in the array at a path, in order; what isn't an array has none."""
    rows = docs.select("*", F.posexplode(field(doc, path, "array<variant>")).alias("ord", "item"))
    return rows.where(is_object("item"))


def members(docs: DataFrame, path: str = "$", doc: str = "doc") -> DataFrame:
    """docs with key and item (VARIANT): the members that are objects of the object at a path."""
    rows = docs.select("*", F.explode(F.map_entries(field(doc, path, "map<string, variant>"))).alias("_e"))
    return rows.select(*docs.columns, F.col("_e.key").alias("key"), F.col("_e.value").alias("item")).where(is_object("item"))


def static_results(files: DataFrame) -> DataFrame:
    """path, shape (object or array), n_items, sha256, problem: what outside analyses left; a document that is a mere value has a problem, too."""
    rows = parsed(files)
    shape = F.when(is_object("doc"), "object").when(is_array("doc"), "array")
    size = F.coalesce(F.size(field("doc", "$", "array<variant>")), F.size(field("doc", "$", "map<string, variant>")))
    return rows.select("path", shape.alias("shape"), F.when(shape.isNotNull(), size).alias("n_items"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.coalesce("problem", F.when(shape.isNull(), "value")).alias("problem"))


def predicates(files: DataFrame) -> DataFrame:
    """path, ord, item: the entries of `State_Definitions`, or if there are none of `Predicates`."""
    rows = parsed(files).where(is_object("doc"))
    states = field("doc", "$.State_Definitions", "array<variant>")
    # anything but an empty value counts, also one that isn't a list: then there are no entries
    counts = F.when(states.isNotNull(), F.size(states) > 0).otherwise(F.coalesce(~field("doc", "$.State_Definitions").isin("", "0", "false"), field("doc", "$.State_Definitions", "map<string, variant>").isNotNull(), F.lit(False)))
    return rows.select("path", F.posexplode(F.when(counts, states).otherwise(field("doc", "$.Predicates", "array<variant>"))).alias("ord", "item"))


def usages(files: DataFrame) -> DataFrame:
    """path, ord, resource_id, name, anchor_node, node_id, file, line: the usages of a report, each with the fields of its anchor; a missing node is -1."""
    groups = objects(parsed(files)).select("path", F.col("ord").alias("_group"), field("item", "$.anchor", "variant").alias("anchor"), F.col("item").alias("doc"))
    rows = objects(groups, "$.usages")
    number = F.coalesce(field("item", "$.usage_point.node_id", "bigint"), F.try_to_number(field("item", "$.usage_point.node_id"), F.lit("999999999999999999")).cast("long"), F.lit(-1).cast("long"))
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return rows.select(
        "path", (F.col("_group").cast("long") * (1 << 31) + F.col("ord")).alias("ord"), F.coalesce(blank(field("anchor", "$.resource_id")), F.lit("UNKNOWN_RESOURCE")).alias("resource_id"),
        F.coalesce(F.trim(field("anchor", "$.anchor_name")), F.lit("")).alias("name"), field("anchor", "$.cpg_node_id").alias("anchor_node"), number.alias("node_id"),
        field("item", "$.usage_point.file").alias("file"), field("item", "$.usage_point.start_line", "int").alias("line"),
    )
