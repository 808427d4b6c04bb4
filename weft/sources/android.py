"""Resource XML, generated bindings, screen dumps and source trees, from (path, text) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.text import is_test_source_set, non_blank, resource_name, snake_to_camel

ELEMENT = r'<([A-Za-z][A-Za-z0-9_.]*)(?=[\s/>])[^<>]*?\sandroid:id\s*=\s*["\']@\+?(?:[\w.]+:)?id/([A-Za-z0-9_.]+)["\']'


def folder(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]+)/[^/]+$", 1)


def family(path: Column) -> Column:
    """The folder's name before its qualifiers."""
    return F.split_part(folder(path), F.lit("-"), F.lit(1))


def resources(files: DataFrame) -> DataFrame:
    """ord, resource_id, name, tag, kind, layout_name, binding_class, binding_field, qualifiers, path of layouts and menus.

    A file that is not XML fails the job.
    """
    rows = files.where(family(F.col("path")).isin("layout", "menu")).where(F.xpath_int("text", F.lit("count(//*)")) > 0)
    tags, names = (F.regexp_extract_all("text", F.lit(ELEMENT), F.lit(i)) for i in (1, 2))
    rows = rows.select("path", "text", F.posexplode(F.arrays_zip(tags.alias("tag"), names.alias("name"))).alias("ord", "e"))
    layout = F.regexp_extract("path", r"([^/]+)\.xml$", 1)
    kind = family(F.col("path"))
    return rows.select(
        "path", "ord", F.concat(F.lit("R.id."), F.col("e.name")).alias("resource_id"), F.col("e.name").alias("name"), F.col("e.tag").alias("tag"), kind.alias("kind"),
        layout.alias("layout_name"), F.when(kind == "layout", snake_to_camel(layout, upper_first=True, suffix="Binding")).alias("binding_class"),
        snake_to_camel("e.name").alias("binding_field"), non_blank(F.regexp_extract(folder(F.col("path")), "^[^-]+-(.*)$", 1)).alias("qualifiers"),
    )


def lines(files: DataFrame) -> DataFrame:
    """path, line (from 1), code."""
    return files.select("path", F.posexplode(F.split("text", "\n")).alias("_n", "code")).select("path", (F.col("_n") + 1).alias("line"), "code")


def id_lines(files: DataFrame, decls: DataFrame) -> DataFrame:
    """path, name, line: the first line of the file on which the id is declared or used."""
    on = lines(files).select("path", "line", F.explode(F.regexp_extract_all("code", F.lit(r"@\+?id/([A-Za-z0-9_.]+)"), F.lit(1))).alias("name"))
    return decls.select("path", "name").distinct().join(on, ["path", "name"]).groupBy("path", "name").agg(F.min("line").alias("line"))


def dependency_roots(files: DataFrame) -> DataFrame:
    """coordinate, root: resource folders of dependencies in a merger file, each once."""
    sets = files.select("path", F.explode(F.regexp_extract_all("text", F.lit(r'(?s)(<dataSet\b[^>]*from-dependency="true"[^>]*>.*?</dataSet>)'), F.lit(1))).alias("set"))
    rows = sets.select(F.regexp_extract("set", r'<dataSet\b[^>]*\bconfig="([^"]*)"', 1).alias("coordinate"), F.explode(F.regexp_extract_all("set", F.lit(r'<source\b[^>]*\bpath="([^"]*)"'), F.lit(1))).alias("root"))
    return rows.distinct()


def binding_fields_of(files: DataFrame) -> DataFrame:
    """path, binding_class, field, raw_type, type, resolution, line of generated binding sources.

    A type is qualified already, or resolved by an import of the file, or stays as written. Each row is a file and is read where
    it lies: nothing is joined or shuffled, and a task holds one text at a time. A file without a path or a binding class has no rows.
    """
    one = lambda code, pattern, group=1: F.regexp_extract(code, pattern, group)
    those = lambda marked, pattern: F.transform(F.filter("_lines", marked), lambda x: one(x, pattern))
    begins = lambda word: lambda x: x.startswith(word)
    owner, field = r"\bclass\s+(\w+Binding)\b", r"public\s+final\s+([\w.]+)\s+(\w+)\s*;"
    public = F.filter(F.transform("_lines", lambda x, i: F.struct((i + 1).alias("line"), x.alias("code"))), lambda x: x["code"].contains("public") & x["code"].contains(";"))
    found = F.transform(public, lambda x: F.struct(x["line"].alias("line"), one(x["code"], field).alias("raw_type"), one(x["code"], field, 2).alias("field")))
    code = files.where("path is not null").select("path", F.split("text", "\n").alias("_lines"))
    code = code.select(
        "path", F.array_min(those(begins("package "), r"^package\s+([\w.]+)")).alias("package"), F.get(those(lambda x: x.contains("class") & x.rlike(owner), owner), F.lit(0)).alias("binding_class"),
        those(begins("import "), r"^import\s+([\w.]+);").alias("_imports"), F.explode(F.filter(found, lambda x: x["field"] != "")).alias("f"),
    )
    rows = code.where("binding_class is not null").select("path", "package", "binding_class", "f.*", F.array_min(F.filter("_imports", lambda x: F.substring_index(x, ".", -1) == F.col("f.raw_type"))).alias("imported"))
    resolution = F.when(F.col("raw_type").contains("."), "qualified").when(F.col("imported").isNotNull(), "import").otherwise("raw")
    kind = F.when(F.col("raw_type").contains("."), F.col("raw_type")).otherwise(F.coalesce("imported", "raw_type"))
    return rows.select("path", F.concat_ws(".", "package", "binding_class").alias("binding_class"), "field", "raw_type", kind.alias("type"), resolution.alias("resolution"), "line")


def screen_nodes(dumps: DataFrame) -> DataFrame:
    """page, ord, attributes (map) of each node of a screen dump; `package`, false and empty attributes are left out."""
    nodes = F.regexp_extract_all("text", F.lit(r"<([A-Za-z][\w.]*\b[^<>]*?)/?>"), F.lit(1))
    rows = dumps.select("page", F.posexplode(F.filter(nodes, lambda x: ~x.startswith("hierarchy"))).alias("ord", "node"))
    at = r"""([\w:.-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    keys = F.regexp_extract_all("node", F.lit(at), F.lit(1))
    values = F.zip_with(F.regexp_extract_all("node", F.lit(at), F.lit(2)), F.regexp_extract_all("node", F.lit(at), F.lit(3)), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
    pairs = F.map_from_entries(F.arrays_zip(keys, values))
    kept = F.map_filter(pairs, lambda k, v: (k != "package") & ~v.isin("", "false"))
    return rows.select("page", "ord", kept.alias("attributes"))


def visible_ids(dumps: DataFrame) -> DataFrame:
    """page, resource_id: distinct resources on screen, in the form that code uses."""
    ids = screen_nodes(dumps).select("page", resource_name(F.try_element_at("attributes", F.lit("resource-id"))).alias("resource_id"))
    return ids.where("resource_id is not null").distinct()


def source_files(files: DataFrame) -> DataFrame:
    """path, text, n_chars, n_lines, sha256 of Kotlin and Java sources outside build folders and test source sets."""
    p = F.col("path")
    kept = files.where(p.rlike(r"\.(kt|java)$") & ~p.rlike(r"(^|/)(build|\.gradle|\.git|\.idea|out)/") & ~is_test_source_set(p) & non_blank("text").isNotNull())
    return kept.select("path", "text", F.length("text").alias("n_chars"), F.size(F.split("text", "\n")).alias("n_lines"), F.sha2("text", 256).alias("sha256"))


def language_census(files: DataFrame) -> DataFrame:
    """language, n of source files."""
    ext = F.regexp_extract("path", r"\.(kt|java)$", 1)
    return files.where(ext != "").groupBy(F.when(ext == "kt", "kotlin").otherwise("java").alias("language")).agg(F.count("*").alias("n"))


def compile_sdk(files: DataFrame) -> DataFrame:
    """sdk by the nearest build file: a literal, else a version catalogue's entry. files: path, depth, text."""
    literal = F.regexp_extract("text", r"compileSdk(?:Version)?\s*[=(]?\s*([0-9]{2})\b", 1)
    catalogue = F.regexp_extract("text", r'(?i)compile_?-?sdk\s*=\s*"([0-9]{2})"', 1)
    rows = files.select("depth", F.when(literal != "", 0).when(catalogue != "", 1).alias("rule"), F.when(literal != "", literal).otherwise(catalogue).alias("sdk"), "path")
    return rows.where("rule is not null").agg(F.min_by("sdk", F.struct("depth", "rule", "path")).cast("int").alias("sdk")).where("sdk is not null")


DECLARATIONS = (
    "resource_id STRING, name STRING, kind STRING, source_type STRING, file STRING, layout_name STRING, tag STRING, binding_class STRING, "
    "binding_field STRING, line STRING, owner STRING, qualified_id STRING, origin STRING, coordinate STRING, qualifiers STRING"
)


def declared(df: DataFrame) -> DataFrame:
    """Declarations of inventory documents, blank fields as null, lines that are no numbers as null; several inventories are one table."""
    from .documents import json_array

    rows = json_array(df, "text", DECLARATIONS)
    rows = rows.select(*[non_blank(c).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes])
    return rows.withColumn("line", F.when(F.col("line").rlike("^[0-9]+$"), F.col("line").cast("int")))


def external_resources(files: DataFrame, roots: DataFrame) -> DataFrame:
    """resources() of the files under dependency roots, with their coordinate: each file sends its parent folders to an equi-join."""
    parts = F.split("path", "/")
    up = files.select("path", "text", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("root"))
    inside = up.join(roots, "root").select("path", "text", "coordinate")
    found = resources(inside.select("path", "text").distinct())
    return found.join(inside.select("path", "coordinate").distinct(), "path")


def cpg_tables(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of a program graph; ids come as text or numbers and are longs from here on."""
    nodes, edges = spark.read.parquet(f"{path}/cpg_node"), spark.read.parquet(f"{path}/cpg_edge")
    ids = {c: F.col(c).cast("long") for c in ("id", "method_id") if c in nodes.columns}
    return nodes.withColumns(ids), edges.withColumns({c: F.col(c).cast("long") for c in ("src", "dst")})


def concatenated_sources(files: DataFrame, app: str) -> DataFrame:
    """app, text: the sources of an application in path order, each below a line with its path."""
    one = F.concat_ws("\n", F.concat(F.lit("// File: "), F.col("path")), "text")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", one.alias("t")))), lambda x: x["t"]), "\n\n")
    return source_files(files).join(files.select("path", app).distinct(), "path").groupBy(app).agg(body.alias("text"))


def resource_aliases(code: DataFrame) -> DataFrame:
    """path, name, ref: constants and variables that stand for a resource. code: path, line, code."""
    at = r"\b(\w+)\s*=\s*(R2?\.id\.\w+)\s*;?"
    rows = code.select("path", F.regexp_extract("code", at, 1).alias("name"), F.regexp_replace(F.regexp_extract("code", at, 2), r"^R2\.", "R.").alias("ref"))
    return rows.where("name <> ''").distinct()


def lookups(calls: DataFrame, aliases: DataFrame) -> DataFrame:
    """node, ref: resources that a lookup means: named ones, else those of an alias, else the dynamic resource. calls: node, path, code."""
    from weft.functions.classify import resource_refs

    direct = calls.select("node", F.explode(resource_refs("code")).alias("ref"))
    open_ = calls.join(direct.select("node").distinct(), "node", "left_anti")
    words = open_.select("node", "path", F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(r"(\w+)"), F.lit(1)))).alias("name"))
    aliased = words.join(aliases, ["path", "name"]).select("node", "ref").distinct()
    rest = open_.join(aliased.select("node").distinct(), "node", "left_anti").select("node", F.lit("UNKNOWN_DYNAMIC_RESOURCE").alias("ref"))
    return direct.unionByName(aliased).unionByName(rest)


def cfg_lookup(methods: DataFrame, index: DataFrame) -> DataFrame:
    """method, path of the control-flow artefact of each wanted method: the recorded path, else the one of its key; methods outside the index are left out."""
    rows = methods.select("method").distinct().join(index, "method")
    return rows.select("method", F.coalesce(non_blank("cfg_path"), F.concat("key", F.lit(".json"))).alias("path"))
