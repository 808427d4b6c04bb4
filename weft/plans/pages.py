"""Screens and windows of conversations, written out of the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators import compaction, graph
from weft.sources import screens as source
from weft.sources import snapshots, variants
from weft.streaming import ordered

from .queries import query, read


def order_screens(spark, sf_dir) -> DataFrame:
    """page, text: a dump for each order, its lines as nodes, a node for the part in each; every fiftieth isn't closed."""
    part = lambda x: F.concat(F.lit("<node text=' p&#38;"), x["l_partkey"], F.lit(" ' clickable='FALSE'/>"))
    line = lambda x: F.concat(F.lit('<node resource-id="l'), x["l_linenumber"], F.lit('" package="x" text="&lt;'), x["l_returnflag"], F.lit('>" focused="'), F.when(x["l_quantity"] > 25, "true").otherwise("false"), F.lit('">'), part(x), F.lit("</node>\n"))
    key = F.struct("l_linenumber", "l_partkey", "l_returnflag", "l_quantity")
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(key)), line), "").alias("body"))
    end = F.when(F.col("page") % 50 == 0, "").otherwise("</hierarchy>")
    return lines.select("page", F.concat(F.lit("<?xml version='1.0'?><hierarchy rotation='0'><!-- <node> -->"), "body", end).alias("text"))


ORDER_SCREENS = """
l AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_quantity) AS i, l_linenumber AS ln, l_partkey AS pk, l_returnflag AS rf, l_quantity > 25 AS big FROM lineitem)
"""


@query(f"""
WITH {ORDER_SCREENS}
SELECT page, 0 AS ord, NULL AS parent, 0 AS level, 'hierarchy' AS name, 'rotation=0' AS attributes FROM (SELECT DISTINCT page FROM l WHERE page % 50 <> 0)
UNION ALL SELECT page, 2 * i - 1, 0, 1, 'node', 'resource-id=l' || ln || ',text=<' || rf || '>' || CASE WHEN big THEN ',focused=true' ELSE '' END FROM l WHERE page % 50 <> 0
UNION ALL SELECT page, 2 * i, 2 * i - 1, 2, 'node', 'text=p&' || pk FROM l WHERE page % 50 <> 0
""")
def screen_tree(spark, sf_dir):
    """The elements of the orders' screens with their parents."""
    rows = source.elements(order_screens(spark, sf_dir))
    return rows.withColumn("attributes", F.array_join(F.transform("attributes", lambda a: F.concat(a["name"], F.lit("="), a["value"])), ","))


@query(f"""
WITH {ORDER_SCREENS}
SELECT page, '<?xml version=''1.0'' encoding=''utf-8''?>' || chr(10) || '<hierarchy rotation="0">' || chr(10) || string_agg('  <node resource-id="l' || ln || '" text="&lt;' || rf || '&gt;"' || CASE WHEN big THEN ' focused="true"' ELSE '' END || '>' || chr(10)
  || '    <node text="p&amp;' || pk || '" />' || chr(10) || '  </node>', chr(10) ORDER BY i) || chr(10) || '</hierarchy>' AS text FROM l WHERE page % 50 <> 0 GROUP BY page
UNION ALL SELECT page, '<?xml version=''1.0''?><hierarchy rotation=''0''><!-- <node> -->' || string_agg('<node resource-id="l' || ln || '" package="x" text="&lt;' || rf || '>" focused="' || CASE WHEN big THEN 'true' ELSE 'false' END || '"><node text='' p&#38;' || pk || ' '' clickable=''FALSE''/></node>' || chr(10), '' ORDER BY i)
  FROM l WHERE page % 50 = 0 GROUP BY page
""")
def screen_texts(spark, sf_dir):
    """The orders' screens compacted; those that aren't well-formed as they are."""
    return source.compacted(order_screens(spark, sf_dir))


def chain_items(spark, sf_dir) -> DataFrame:
    """Sources as chains, documents as steps, lines as items: every third character count starts anew, lines of even length are compacted."""
    docs = read(spark, sf_dir, "documents")
    rows = docs.select(F.col("source").alias("chain"), F.col("doc_id").alias("step"), (F.col("n_chars") % 3 == 0).alias("replaces"), F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    return rows.withColumn("type", F.when(F.length("text") % 2 == 0, "x.Compaction").when(F.col("ord") == 0, "compaction_summary").otherwise("message"))


CHAINS = """
i AS (SELECT source AS chain, doc_id AS step, n_chars % 3 = 0 AS rep, o - 1 AS ord, ls[o] AS text, length(ls[o]) % 2 = 0 OR o = 1 AS comp FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS o FROM (SELECT *, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
e AS (SELECT chain, step, count(*) AS n_output, count(*) FILTER (WHERE comp) AS own_items, CAST(coalesce(sum(length(text)) FILTER (WHERE comp), 0) AS BIGINT) AS own_chars, bool_or(rep) AS rep FROM i GROUP BY 1, 2),
m AS (SELECT e.*, mode, CASE mode WHEN 'chain' THEN true WHEN 'independent' THEN false ELSE rep END AS new FROM e, (VALUES ('chain'), ('independent'), ('mixed')) v(mode)),
b AS (SELECT *, max(CASE WHEN new THEN step END) OVER (PARTITION BY chain, mode ORDER BY step) AS first_step FROM m),
s AS (SELECT *, CAST(sum(own_items) OVER w AS BIGINT) AS window_items, CAST(sum(own_chars) OVER w AS BIGINT) AS window_chars FROM b WINDOW w AS (PARTITION BY chain, mode, first_step ORDER BY step))
"""


@query(f"WITH {CHAINS} SELECT mode, chain, step, n_output, n_output - own_items AS n_raw, own_items, own_chars, window_items - own_items AS \"offset\", window_items, window_chars, first_step, true AS ran FROM s")
def compaction_steps(spark, sf_dir):
    """Windows after each document: as a chain, with independent chunks, and with both kinds of steps."""
    items, out = chain_items(spark, sf_dir), None
    for mode in ("chain", "independent", "mixed"):
        one = compaction.steps(items, mode).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""
WITH {CHAINS}, t AS (SELECT chain, arg_max(first_step, step) AS since FROM s WHERE mode = 'mixed' GROUP BY chain)
SELECT chain, row_number() OVER (PARTITION BY chain ORDER BY step, ord) - 1 AS place, step, ord, CASE WHEN length(text) % 2 = 0 THEN 'x.Compaction' ELSE 'compaction_summary' END AS type, text
FROM i JOIN t USING (chain) WHERE comp AND (since IS NULL OR step >= since)
""")
def compaction_windows(spark, sf_dir):
    """The items of the last window of each source."""
    items = chain_items(spark, sf_dir)
    return compaction.window(items, compaction.steps(items, "mixed"))


# ---------------------------------------------------------------- documents of unknown shape

JSON_KINDS = [
    '[{"id": <k>, "s": "<p>"}, 7, {"id": "<k>", "s": null}]',
    '{"a": {"id": <k>}, "b": 3, "State_Definitions": [], "Predicates": [{"name": "<p>", "x": 1}]}',
    '{"State_Definitions": [{"name": "<s>"}, {"name": "<p>"}], "a": {"id": "<k>"}}',
    '[{"id": <k>',
    "42",
    '{"Predicates": {"name": "no list"}, "a": [1]}',
]
_KIND = "CASE o_orderkey % 7 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(JSON_KINDS)) + " END"
_TEXT = f"replace(replace(replace({_KIND}, '<k>', CAST(o_custkey AS VARCHAR(20))), '<p>', o_orderpriority), '<s>', o_orderstatus)"
JSON_TEXTS = f"t AS (SELECT CAST(o_orderkey AS VARCHAR(20)) AS path, o_orderkey % 7 AS kind, CAST(o_custkey AS VARCHAR(20)) AS k, o_orderpriority AS p, o_orderstatus AS s, {_TEXT} AS text FROM orders)"


def json_files(spark, sf_dir) -> DataFrame:
    """path, text: a document for each order, of six kinds, or none."""
    return read(spark, sf_dir, "orders").select(F.expr("CAST(o_orderkey AS STRING)").alias("path"), F.expr(_TEXT.replace("VARCHAR(20)", "STRING")).alias("text"))


@query(f"""
WITH {JSON_TEXTS}
SELECT path, CASE WHEN kind = 0 THEN 'array' WHEN kind IN (1, 2, 5) THEN 'object' END AS shape, CASE kind WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 2 WHEN 5 THEN 2 END AS n_items, sha256(text) AS sha256,
  CASE kind WHEN 3 THEN 'malformed' WHEN 4 THEN 'value' WHEN 6 THEN 'missing' END AS problem FROM t
""")
def json_shapes(spark, sf_dir):
    return variants.static_results(json_files(spark, sf_dir))


@query(f"WITH {JSON_TEXTS} SELECT path, 0 AS ord, k AS id, p AS s FROM t WHERE kind = 0 UNION ALL SELECT path, 2, k, NULL FROM t WHERE kind = 0")
def json_items(spark, sf_dir):
    rows = variants.objects(variants.parsed(json_files(spark, sf_dir)))
    return rows.select("path", "ord", variants.field("item", "$.id").alias("id"), variants.field("item", "$.s").alias("s"))


@query(f"WITH {JSON_TEXTS} SELECT path, 'a' AS key, k AS id FROM t WHERE kind IN (1, 2) UNION ALL SELECT path, 'Predicates', NULL FROM t WHERE kind = 5")
def json_members(spark, sf_dir):
    rows = variants.members(variants.parsed(json_files(spark, sf_dir)))
    return rows.select("path", "key", variants.field("item", "$.id").alias("id"))


@query(f"WITH {JSON_TEXTS} SELECT path, 0 AS ord, p AS name FROM t WHERE kind = 1 UNION ALL SELECT path, 0, s FROM t WHERE kind = 2 UNION ALL SELECT path, 1, p FROM t WHERE kind = 2")
def json_predicates(spark, sf_dir):
    return variants.predicates(json_files(spark, sf_dir)).select("path", "ord", variants.field("item", "$.name").alias("name"))


@query("""
SELECT CAST(l_orderkey AS VARCHAR) AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS ord, CASE WHEN l_orderkey % 5 = 1 THEN 'UNKNOWN_RESOURCE' ELSE 'R.' || o_custkey END AS resource_id,
  o_orderpriority AS name, NULL AS anchor_node, CASE WHEN l_quantity > 45 THEN -1 ELSE l_partkey END AS node_id, 'S' || l_suppkey AS file, l_linenumber AS line FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey % 9 <> 0
""")
def json_usages(spark, sf_dir):
    """A report for each order, its lines as usages: nodes as numbers, as texts, or left out; every ninth report is cut off."""
    node = F.when(F.col("l_quantity") > 45, "").when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(', "node_id": "'), "l_partkey", F.lit('"'))).otherwise(F.concat(F.lit(', "node_id": '), "l_partkey"))
    item = F.concat(F.lit('{"usage_point": {"file": "S'), "l_suppkey", F.lit('", "start_line": '), "l_linenumber", node, F.lit("}}"))
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", item.alias("item")))), lambda x: x["item"]), ",").alias("body"))
    resource = F.when(F.col("o_orderkey") % 5 == 1, " ").otherwise(F.concat(F.lit("R."), "o_custkey"))
    text = F.concat(F.lit('[{"anchor": {"resource_id": "'), resource, F.lit('", "anchor_name": " '), "o_orderpriority", F.lit('"}, "usages": ['), "body", F.when(F.col("o_orderkey") % 9 == 0, "").otherwise("]}]"))
    rows = lines.join(read(spark, sf_dir, "orders"), "o_orderkey").select(F.col("o_orderkey").cast("string").alias("path"), text.alias("text"))
    return variants.usages(rows)


# ---------------------------------------------------------------- snapshots


@query("""
WITH r AS (SELECT o_custkey AS k, o_orderkey AS n, o_orderstatus AS status, CAST(o_orderkey % 3 AS INTEGER) AS turn FROM orders),
v AS (SELECT 'replaced' AS kind, k, max(n) AS n, arg_max(status, n) AS status, CAST(NULL AS INTEGER) AS since FROM r GROUP BY k)
SELECT kind, k, n, status, since FROM v UNION ALL SELECT 'history', k, n, status, turn + 1 FROM r
""")
def snapshot_tables(spark, sf_dir):
    """Orders committed in three turns, once put in by customer, once appended as a history, and read back from their last versions."""
    folder = f"{graph.shared_folder(spark)}/snapshots-{uuid.uuid4().hex}"
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("n"), F.col("o_orderstatus").alias("status"))
    current, history = snapshots.Snapshots(spark, f"{folder}/current"), snapshots.Snapshots(spark, f"{folder}/history")
    for turn in range(3):
        rows = orders.where(F.col("n") % 3 == turn)
        snapshots.upsert(current, rows, ["k"], "n")
        history.write(rows, turn, append=True)
    out = current.read().drop("_since").withColumns({"kind": F.lit("replaced"), "since": F.lit(None).cast("int")})
    return out.unionByName(history.read().withColumn("kind", F.lit("history")).withColumnRenamed("_since", "since")).select("kind", "k", "n", "status", "since")


@query("""
WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS name FROM conversations), f AS (SELECT conv_id, name, min(turn) AS turn FROM w GROUP BY 1, 2), n AS (SELECT conv_id, turn, count(*) AS n FROM f GROUP BY 1, 2)
SELECT c.conv_id AS conversation, c.turn AS page, 0 AS skipped, coalesce(n, 0) AS n_new, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY c.conv_id ORDER BY c.turn) AS BIGINT) AS n_total FROM conversations c LEFT JOIN n USING (conv_id, turn)
""")
def ordered_turns(spark, sf_dir):
    """Turns as pages of a stream that delivers each of them twice: the words that every turn adds to its conversation."""
    folder = f"{graph.shared_folder(spark)}/turns-{uuid.uuid4().hex}"
    fields = read(spark, sf_dir, "conversations").schema
    turns = spark.readStream.schema(fields).parquet(f"{sf_dir}/conversations.parque[t]")  # a pattern may be a file or a folder
    at = F.timestamp_seconds(1_700_000_000 + F.col("turn"))
    pages = turns.select(F.col("conv_id").alias("conversation"), F.col("turn").alias("page"), F.split("text", " ").alias("names"), at.alias("at"))
    ordered.run(pages.unionAll(pages), f"{folder}/out", f"{folder}/state")
    return spark.read.schema(ordered.SCHEMA).parquet(f"{folder}/out")
