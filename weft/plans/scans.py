"""Scans of files, held against SQL: the files are written out of the driver's tables, the SQL says what is to be found in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import classify, text
from weft.operators import program
from weft.sources import android

from .queries import query, read


def parts(spark, sf_dir):
    """Part keys with their names in snake case and in camel case."""
    snake = F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "_")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_size", "p_brand", snake.alias("s"))


#: The same rows for SQL: k, p_size, p_brand, s, and the name as class and as field.
PARTS = """
p AS (SELECT p_partkey AS k, p_size, p_brand, regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g') AS s FROM part),
q AS (SELECT *, array_to_string(list_transform(list_filter(string_split(s, '_'), lambda x: x <> ''), lambda x: upper(x[1:1]) || x[2:]), '') AS big FROM p),
r AS (SELECT *, lower(big[1:1]) || big[2:] AS small FROM q)
"""


@query("SELECT c_custkey, CASE lower(c_mktsegment) WHEN 'building' THEN 'Building' WHEN 'machinery' THEN 'Machinery' ELSE lower(c_mktsegment) END AS kind, 'Other' AS blank FROM customer")
def coerced_names(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.lower("c_mktsegment").alias("x"))
    return rows.select("c_custkey", text.coerced("x", ["Building", "Machinery"], "Other").alias("kind"), text.coerced(F.lit(" "), ["Building"], "Other").alias("blank"))


@query(f"""
WITH {PARTS} SELECT k, 'R.id.' || s || ',a.R2.id.p' || k AS refs, 'f' || p_size || ',inflate' AS fields, 'MainBinding' AS classes FROM r
""")
def code_references(spark, sf_dir):
    """Resource references, fields and classes of bindings in lines of code."""
    line = F.concat(F.lit("find(R.id."), "s", F.lit("); a.R2.id.p"), "k", F.lit("; R.id."), "s", F.lit("; binding.f"), "p_size", F.lit(".x = binding.root; MainBinding.inflate(i)"))
    rows = parts(spark, sf_dir).withColumn("code", line)
    return rows.select("k", *(F.array_join(f("code"), ",").alias(n) for n, f in (("refs", classify.resource_refs), ("fields", classify.binding_fields), ("classes", classify.binding_classes))))


def layouts(spark, sf_dir):
    """A layout, a menu or a values file for each part, with two ids in it."""
    rows = parts(spark, sf_dir)
    kind = F.when(F.col("k") % 3 == 0, F.lit("layout-land")).when(F.col("k") % 3 == 1, F.lit("menu")).otherwise(F.lit("values"))
    xml = F.concat(F.lit('<a xmlns:android="u">\n<TextView android:id="@+id/'), "s", F.lit('"/>\n<Button android:x="1" android:id="@id/b'), "k", F.lit('"/>\n<View android:y="@+id/'), "s", F.lit('"/></a>'))
    return rows.select(F.concat(F.lit("res/"), kind, F.lit("/part_"), "k", F.lit(".xml")).alias("path"), xml.alias("text"))


@query(f"""
WITH {PARTS}, f AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'layout' ELSE 'menu' END AS kind, CASE WHEN k % 3 = 0 THEN 'land' END AS qualifiers FROM r WHERE k % 3 < 2),
e AS (SELECT k, kind, qualifiers, 0 AS ord, s AS name, 'TextView' AS tag, small AS binding_field FROM f UNION ALL SELECT k, kind, qualifiers, 1, 'b' || k, 'Button', 'b' || k FROM f)
SELECT 'res/' || kind || CASE WHEN qualifiers IS NULL THEN '' ELSE '-land' END || '/part_' || k || '.xml' AS path, ord, 'R.id.' || name AS resource_id, name, tag, kind, 'part_' || k AS layout_name,
  CASE WHEN kind = 'layout' THEN 'Part' || k || 'Binding' END AS binding_class, binding_field, qualifiers FROM e
""")
def layout_resources(spark, sf_dir):
    """Ids that layouts and menus declare; values files declare none."""
    return android.resources(layouts(spark, sf_dir))


@query(f"""
WITH {PARTS}, f AS (SELECT *, 'res/' || CASE WHEN k % 3 = 0 THEN 'layout-land' ELSE 'menu' END || '/part_' || k || '.xml' AS path FROM r WHERE k % 3 < 2)
SELECT path, s AS name, 2 AS line FROM f UNION ALL SELECT path, 'b' || k, 3 FROM f
""")
def declared_lines(spark, sf_dir):
    files = layouts(spark, sf_dir)
    return android.id_lines(files, android.resources(files))


@query("SELECT DISTINCT 'group:' || lower(replace(p_brand, '#', '')) || ':1' AS coordinate, '/cache/' || p_size || '/res' AS root FROM part")
def merger_roots(spark, sf_dir):
    """Dependency folders in merger files; the project's own sources are none."""
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))
    xml = F.concat(F.lit('<merger>\n<dataSet config="group:'), brand, F.lit(':1" from-dependency="true">\n<source path="/cache/'), "p_size", F.lit('/res"/></dataSet>\n<dataSet config="main"><source path="/own"/></dataSet></merger>'))
    return android.dependency_roots(parts(spark, sf_dir).select(F.col("k").cast("string").alias("path"), xml.alias("text")))


@query(f"""
WITH {PARTS} SELECT 'gen/' || k || '.java' AS path, 'app.b.' || big || 'Binding' AS binding_class, f.field, f.raw_type, f.type, f.resolution, f.line
FROM r, (VALUES ('a', 'TextView', 'android.widget.TextView', 'import', 4), ('b', 'android.view.View', 'android.view.View', 'qualified', 5), ('c', 'Own', 'Own', 'raw', 6)) AS f(field, raw_type, type, resolution, line)
""")
def generated_bindings(spark, sf_dir):
    """Fields of generated binding classes, their types imported, qualified or as written."""
    rows = parts(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k")  # the table's few bytes become long texts
    name = text.snake_to_camel("s", True, "Binding")
    java = F.concat(F.lit("package app.b;\nimport android.widget.TextView;\npublic final class "), name, F.lit(" {\n  public final TextView a;\n  public final android.view.View b;\n  public final Own c;\n  private int d;\n}"))
    return android.binding_fields_of(rows.select(F.concat(F.lit("gen/"), "k", F.lit(".java")).alias("path"), java.alias("text")))


def screens(spark, sf_dir):
    """A screen dump for each customer, the nation on it as a node."""
    rows = read(spark, sf_dir, "customer")
    node = F.concat(F.lit("<hierarchy rotation='0'><node resource-id='org.app:id/n"), "c_nationkey", F.lit("' package='p' clickable=\"false\" text='"), "c_mktsegment", F.lit("'><node resource-id=\"R.id.c"), F.col("c_custkey") % 10, F.lit('" text=""/></node></hierarchy>'))
    return rows.select(F.col("c_custkey").alias("page"), node.alias("text"))


@query("""
SELECT page, ord, keys, vals FROM (SELECT c_custkey AS page, 0 AS ord, 'resource-id,text' AS keys, 'org.app:id/n' || c_nationkey || ',' || c_mktsegment AS vals FROM customer
UNION ALL SELECT c_custkey, 1, 'resource-id', 'R.id.c' || c_custkey % 10 FROM customer)
""")
def screen_attributes(spark, sf_dir):
    rows = android.screen_nodes(screens(spark, sf_dir))
    return rows.select("page", "ord", F.array_join(F.map_keys("attributes"), ",").alias("keys"), F.array_join(F.map_values("attributes"), ",").alias("vals"))


@query("SELECT c_custkey AS page, 'R.id.n' || c_nationkey AS resource_id FROM customer UNION ALL SELECT c_custkey, 'R.id.c' || c_custkey % 10 FROM customer")
def screen_ids(spark, sf_dir):
    return android.visible_ids(screens(spark, sf_dir))


def tree(spark, sf_dir):
    """Paths with documents as their contents: sources, build output, tests and other files."""
    folder = F.element_at(F.array(*map(F.lit, ("app/src/main/java/", "app/build/x/", "app/src/test/java/", "lib/src/main/kotlin/"))), (F.col("doc_id") % 4 + 1).cast("int"))
    ending = F.element_at(F.array(*map(F.lit, (".kt", ".java", ".xml"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return read(spark, sf_dir, "documents").select(F.concat(folder, F.lit("F"), "doc_id", ending).alias("path"), "text")


TREE = """
t AS (SELECT ['app/src/main/java/', 'app/build/x/', 'app/src/test/java/', 'lib/src/main/kotlin/'][doc_id % 4 + 1] || 'F' || doc_id || ['.kt', '.java', '.xml'][doc_id % 3 + 1] AS path, doc_id, text FROM documents)
"""


@query(f"""
WITH {TREE} SELECT path, length(text) AS n_chars, len(string_split(text, chr(10))) AS n_lines, sha256(text) AS sha256 FROM t WHERE doc_id % 4 IN (0, 3) AND doc_id % 3 < 2 AND regexp_matches(text, '\\S')
""")
def scanned_sources(spark, sf_dir):
    """Sources outside build folders and tests, with sizes and hashes."""
    return android.source_files(tree(spark, sf_dir)).drop("text")


@query(f"WITH {TREE} SELECT CASE WHEN path LIKE '%.kt' THEN 'kotlin' ELSE 'java' END AS language, count(*) AS n FROM t WHERE path NOT LIKE '%.xml' GROUP BY 1")
def source_languages(spark, sf_dir):
    return android.language_census(tree(spark, sf_dir))


@query("SELECT 20 + min(s_suppkey) % 10 AS sdk FROM supplier")
def build_sdk(spark, sf_dir):
    """The nearest build file that names an SDK decides."""
    s = read(spark, sf_dir, "supplier")
    files = s.select(F.concat(F.lit("m"), "s_suppkey", F.lit("/build.gradle")).alias("path"), F.col("s_suppkey").alias("depth"), F.concat(F.lit("android {\n  compileSdk = "), 20 + F.col("s_suppkey") % 10, F.lit("\n}")).alias("text"))
    return android.compile_sdk(files.unionAll(s.select(F.lit("settings.gradle"), F.lit(-1).cast(s.schema["s_suppkey"].dataType), F.lit("include ':app'"))))


@query(f"""
WITH {PARTS} SELECT 'R.id.' || s AS resource_id, s AS name, CASE WHEN k % 2 = 0 THEN k END AS line, CAST(NULL AS VARCHAR) AS owner FROM r
""")
def declared_inventory(spark, sf_dir):
    """Inventory documents read back: blank fields are null, lines that are no numbers as well."""
    line = F.when(F.col("k") % 2 == 0, F.col("k").cast("string")).otherwise(F.lit("?"))
    doc = F.to_json(F.array(F.struct(F.concat(F.lit("R.id."), "s").alias("resource_id"), F.col("s").alias("name"), line.alias("line"), F.lit(" ").alias("owner"))))
    return android.declared(parts(spark, sf_dir).select(F.col("k").cast("string").alias("path"), doc.alias("text"))).select("resource_id", "name", "line", "owner")


@query("""
SELECT p_partkey AS owner, CASE p_size % 4 WHEN 0 THEN 'MutableStateFlow' WHEN 1 THEN 'LiveData' WHEN 2 THEN 'Observable' END AS stream FROM part WHERE p_size % 4 < 3
""")
def state_streams(spark, sf_dir):
    """Properties of reactive types; plain lists are none."""
    kind = F.element_at(F.array(*map(F.lit, ("MutableStateFlow<", "LiveData<", "io.Observable<", "List<"))), (F.col("p_size") % 4 + 1).cast("int"))
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("owner"), F.concat(kind, F.lit("Int>")).alias("type"))
    return program.state_streams(rows).select("owner", "stream")
