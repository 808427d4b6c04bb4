"""JSON documents, slicer output, page captures, run folders, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.text import first_non_blank, non_blank, normalized

PATH_STEP = "STRUCT<direction: STRING, path_methods: ARRAY<STRING>, root_callback: STRING, callback_kind: STRING, relation: STRING>"
USAGE_POINT = "STRUCT<node_id: STRING, node_label: STRING, file: STRING, start_line: INT, end_line: INT, code: STRING, usage_kind: STRING>"
ANCHORS = (
    "resource_id STRING, anchor_name STRING, location STRING, view_type STRING, cpg_node_id STRING, usage_type STRING, occurrence_role STRING, handle_name STRING, "
    "binding_field STRING, anchor_location STRING, occurrence_location STRING, occurrence_node_id STRING, handle_owner_node_id STRING"
)
USAGES = (
    "anchor STRUCT<resource_id: STRING, anchor_name: STRING, view_type: STRING, usage_type: STRING, cpg_node_id: STRING, cpg_node_type: STRING, "
    "declaration_scope: STRING, location: STRING, code: STRING>, "
    f"usages ARRAY<STRUCT<anchor_id: STRING, usage_point: {USAGE_POINT}, enclosing_method_full_name: STRING>>"
)
SLICES = (
    "primary_method STRING, affecting_usages ARRAY<STRUCT<anchor_id: STRING, view_type: STRING, anchor_usage_type: STRING, "
    f"usage_point: {USAGE_POINT}, enclosing_method_full_name: STRING, declaration_scope: STRING>>, call_paths ARRAY<{PATH_STEP}>, "
    "method_body_refs ARRAY<STRING>, domain_type_refs ARRAY<STRING>, root_callbacks ARRAY<STRING>, incomplete BOOLEAN, validation_errors ARRAY<STRING>"
)
METHOD = "STRUCT<method_full_name: STRING, method_id: STRING, method_name: STRING, file: STRING, start_line: INT, end_line: INT, signature: STRING, body: STRING>"
TYPE = "STRUCT<type_full_name: STRING, kind: STRING, file: STRING, start_line: INT, end_line: INT, body: STRING>"


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of every file under a path."""
    return spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def json_array(df: DataFrame, text: str, schema: str) -> DataFrame:
    """path, ord and the fields of each element; what is not an array of such objects has no rows."""
    array = F.when(F.ltrim(text).startswith("["), F.col(text))  # the parser takes a single object for an array of one
    rows = df.select("path", F.posexplode(F.from_json(array, f"ARRAY<STRUCT<{_fields(schema)}>>")).alias("ord", "row"))
    return rows.where("row is not null").select("path", "ord", "row.*")


def _fields(schema: str) -> str:
    """A table schema's columns in the form that struct types take."""
    out, depth = [], 0
    start = 0
    for i, c in enumerate(schema + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = schema[start:i].strip().split(" ", 1)
            out.append(f"{name}: {kind}")
            start = i + 1
    return ", ".join(out)


def json_map(df: DataFrame, text: str, value: str) -> DataFrame:
    """path, ord, key and the value's fields of a JSON object of objects, in the order in which it lists them."""
    rows = df.select("path", F.posexplode(F.map_entries(F.from_json(text, f"MAP<STRING, {value}>"))).alias("ord", "e"))
    return rows.select("path", "ord", "e.key", "e.value.*")


def anchors(df: DataFrame) -> DataFrame:
    return json_array(df, "text", ANCHORS)


def usages(df: DataFrame) -> DataFrame:
    """ord, resource_id, name, location, node_ids, code, usage_kind, method, file, line: a row for each usage."""
    groups = json_array(df, "text", USAGES)
    rows = groups.select("path", F.col("ord").alias("g"), "anchor", F.posexplode("usages").alias("n", "u"))
    return rows.select(
        "path",
        (F.col("g").cast("long") * (1 << 31) + F.col("n")).alias("ord"),
        F.coalesce(non_blank("anchor.resource_id"), F.lit("UNKNOWN_RESOURCE")).alias("resource_id"),
        normalized("anchor.anchor_name").alias("name"),
        normalized("anchor.location").alias("location"),
        F.filter(F.array(normalized("anchor.cpg_node_id"), normalized("u.anchor_id")), lambda x: x != "").alias("node_ids"),
        F.col("u.usage_point.code").alias("code"),
        F.col("u.usage_point.usage_kind").alias("usage_kind"),
        F.col("u.enclosing_method_full_name").alias("method"),
        F.col("u.usage_point.file").alias("file"),
        F.col("u.usage_point.start_line").alias("line"),
        F.coalesce(F.try_to_number("u.usage_point.node_id", F.lit("999999999999999999")).cast("long"), F.lit(-1)).alias("node_id"),
    )


def slices(df: DataFrame) -> DataFrame:
    out = json_array(df, "text", SLICES).withColumn("incomplete", F.coalesce("incomplete", F.lit(False)))
    return out.withColumnRenamed("ord", "slice").withColumn("resource_ids", F.array_distinct(F.filter(F.transform("affecting_usages", lambda u: u["anchor_id"]), lambda x: x.isNotNull())))


def method_bodies(df: DataFrame) -> DataFrame:
    return json_map(df, "text", METHOD).withColumn("method_full_name", first_non_blank("method_full_name", "key"))


def type_index(df: DataFrame) -> DataFrame:
    return json_map(df, "text", TYPE).withColumn("type_full_name", first_non_blank("type_full_name", "key"))


def predicates(df: DataFrame) -> DataFrame:
    """path, ord, name, description, evidence of `State_Definitions`, else of `Predicates`; unreadable documents have none."""
    one = "ARRAY<STRUCT<name: STRING, description: STRING, evidence: STRING, variables: ARRAY<STRUCT<name: STRING, type: STRING, description: STRING, value_options: ARRAY<STRING>>>>>"
    doc = F.from_json("text", f"STRUCT<State_Definitions: {one}, Predicates: {one}>")
    rows = df.select("path", F.posexplode(F.coalesce(doc["State_Definitions"], doc["Predicates"])).alias("ord", "p"))
    return rows.select("path", "ord", "p.*")


def page_number(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, "(?:^|/)page_([0-9]+)(?:/|$)", 1), F.lit("")).cast("int")


def in_range(page: Column, spec: str | None) -> Column:
    """Whether a page is in `a:b`, `a:`, `:b` or `n`, ends included."""
    if not spec:
        return F.lit(True)
    low, colon, high = spec.partition(":")
    if not colon:
        return page == int(low)
    return (page >= int(low) if low else F.lit(True)) & (page <= int(high) if high else F.lit(True))


def pages(files: DataFrame, spec: str | None = None) -> DataFrame:
    """files with `page`, those of the selected pages; raises if there are none."""
    out = files.withColumn("page", page_number(F.col("path"))).where(F.col("page").isNotNull() & in_range(F.col("page"), spec))
    if out.isEmpty():
        raise ValueError(f"no page in {spec or 'the input'}")
    return out


def latest_run(files: DataFrame, needed: list[str]) -> DataFrame:
    """run, modified: the newest folder that holds all needed files. files: path, modified."""
    rows = files.select(F.regexp_extract("path", "^(.*)/[^/]+$", 1).alias("run"), F.element_at(F.split("path", "/"), -1).alias("file"), "modified")
    whole = rows.where(F.col("file").isin(needed)).groupBy("run").agg(F.countDistinct("file").alias("n"), F.max("modified").alias("modified")).where(F.col("n") == len(needed))
    return whole.agg(F.max_by("run", F.struct("modified", "run")).alias("run"), F.max("modified").alias("modified")).where("run is not null")


def merge_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """page, fields, outputs (maps): new entries overwrite old ones key by key."""
    m = "map<string,string>"
    none = F.create_map().cast(m)
    both = old.select("page", F.col("fields").alias("_f"), F.col("outputs").alias("_o")).join(new, "page", "full_outer")
    over = lambda a, b: F.map_zip_with(F.coalesce(a, none), F.coalesce(b, none), lambda k, x, y: F.coalesce(y, x))
    return both.select("page", over(F.col("_f"), F.col("fields")).alias("fields"), over(F.col("_o"), F.col("outputs")).alias("outputs"))


def next_page(state: DataFrame) -> DataFrame:
    """page: the recorded count plus one, else the largest page plus one. state: page_count (may be null), page."""
    return state.agg((F.coalesce(F.max("page_count"), F.max("page"), F.lit(0)) + 1).alias("page"))


def write_sorted(df: DataFrame, path: str, keys: list[str]) -> None:
    """JSON lines in key order across files."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").json(path)
