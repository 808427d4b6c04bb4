"""Further operators over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from weft.functions import classify, text
from weft.operators import cfg, evidence, graph, merge, pack, program, ranked, render
from weft.sources import documents
from weft.streaming import accumulate

from .queries import EVENT_GRAPH, ORACLES, event_graph, query, read

# ---------------------------------------------------------------- functions


@query("""
SELECT DISTINCT s AS snake, array_to_string(list_transform(string_split(s, '_'), lambda x: upper(x[1:1]) || x[2:]), '') || 'Binding' AS class_name,
  lower(s[1:1]) || substr(array_to_string(list_transform(string_split(s, '_'), lambda x: upper(x[1:1]) || x[2:]), ''), 2) AS field, s AS back
FROM (SELECT regexp_replace(lower(p_name), ' ', '_', 'g') AS s FROM part)
""")
def name_codecs(spark, sf_dir):
    """Part names as layout names: class, field, and back."""
    rows = read(spark, sf_dir, "part").select(F.regexp_replace(F.lower("p_name"), " ", "_").alias("snake")).distinct()
    rows = rows.withColumns({"class_name": text.snake_to_camel("snake", True, "Binding"), "field": text.snake_to_camel("snake")})
    return rows.withColumn("back", text.camel_to_snake("field"))


@query("SELECT page_id, split_part(url || ':' || page_id, ':', 1) AS file, CAST(page_id AS INTEGER) AS line FROM pages")
def location_split(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", F.concat_ws(":", "url", F.col("page_id").cast("string")).alias("at"))
    return rows.select("page_id", text.file_of("at").alias("file"), text.line_of("at").alias("line"))


@query("""
SELECT DISTINCT m AS method, 'app.' || b || '.lambda$' || e || '$0' AS full_name, 'app.' || b || '.' || e AS host, b || '.' || e || ':void()' AS short
FROM (SELECT p_brand AS b, lower(regexp_replace(p_type, '[^A-Za-z]', '', 'g')) AS e, 'app.' || p_brand || '.' || lower(regexp_replace(p_type, '[^A-Za-z]', '', 'g')) || ':void()' AS m FROM (SELECT replace(p_brand, '#', '') AS p_brand, p_type FROM part))
""")
def method_names(spark, sf_dir):
    """Brands as classes and types as methods: lambda hosts and short names."""
    part = read(spark, sf_dir, "part").select(F.replace("p_brand", F.lit("#"), F.lit("")).alias("b"), F.lower(F.regexp_replace("p_type", "[^A-Za-z]", "")).alias("e")).distinct()
    rows = part.select(F.concat(F.lit("app."), "b", F.lit("."), "e", F.lit(":void()")).alias("method"), F.concat(F.lit("app."), "b", F.lit(".lambda$"), "e", F.lit("$0")).alias("full_name"))
    return rows.select("method", "full_name", text.lambda_host("full_name").alias("host"), text.short_method("method").alias("short"))


@query("SELECT doc_id, sha256(text) AS sha, 'screen:' || lang || ':' || substr(sha256(text), 1, 12) AS cache_key FROM documents")
def cache_keys(spark, sf_dir):
    rows = read(spark, sf_dir, "documents")
    return rows.select("doc_id", text.digest("text").alias("sha"), text.cache_key(F.lit("screen"), "lang", "text").alias("cache_key"))


@query("""
SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS cached_tokens, 0::BIGINT AS prompt_tokens FROM events
""")
def token_extraction(spark, sf_dir):
    """The one number in an event's properties as the number of cached tokens."""
    usage = F.concat(F.lit('{"prompt_tokens_details": {"cached_tokens": '), F.get_json_object("props", "$.k"), F.lit("}}"))
    rows = program.token_usage(read(spark, sf_dir, "events").select(F.col("event_id").alias("request"), usage.alias("usage")))
    return rows.select(F.col("request").alias("event_id"), "cached_tokens", "prompt_tokens")


@query("SELECT event_type, count(*) AS n, CAST(sum(length(coalesce(props, ''))) AS BIGINT) AS n_chars FROM events GROUP BY 1")
def item_histogram(spark, sf_dir):
    return program.item_histogram(read(spark, sf_dir, "events"), "event_type", "props")


# ---------------------------------------------------------------- joins


@query("""
WITH s AS (SELECT c_custkey AS state, c_mktsegment || c_nationkey AS f, c_nationkey AS c, n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey),
v AS (SELECT s_suppkey AS view, 'BUILDING' || s_nationkey AS f, s_nationkey AS c, n_regionkey AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT state, view, min(level) AS level FROM (SELECT state, view, 1 AS level FROM s JOIN v USING (f) UNION ALL SELECT state, view, 2 FROM s JOIN v USING (c) UNION ALL SELECT state, view, 3 FROM s JOIN v USING (r)) GROUP BY 1, 2
""")
def view_contexts(spark, sf_dir):
    """Customers as states and suppliers as views: segment and nation, nation, region as function, class and file."""
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("class"), F.col("n_regionkey").alias("file"))
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("state"), F.concat("c_mktsegment", "c_nationkey").alias("function"), F.col("c_nationkey").alias("class")).join(nation, "class")
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("view"), F.concat(F.lit("BUILDING"), "s_nationkey").alias("function"), F.col("s_nationkey").alias("class")).join(nation, "class")
    return program.view_contexts(c, s)


@query("""
WITH w AS (SELECT DISTINCT href FROM (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)), f AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]+/(.*)$', 1) AS file FROM pages),
t AS (SELECT href, d, array_to_string(p[d:], '/') AS file FROM (SELECT href, string_split(href, '/') AS p, unnest(range(1, len(string_split(href, '/')) + 1)) AS d FROM w))
SELECT w.href AS path, arg_min(f.file, d) AS file FROM w LEFT JOIN (t JOIN f ON f.file = t.file) ON t.href = w.href GROUP BY 1
""")
def resolved_files(spark, sf_dir):
    """Links as recorded paths, pages without their host as files."""
    pages = read(spark, sf_dir, "pages")
    wanted = pages.select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("path"))
    return program.resolved_files(wanted, pages.select(F.regexp_extract("url", "^[a-z]+://[^/]+/(.*)$", 1).alias("file")))


@query("""
WITH m AS (SELECT c_custkey AS model, n_name AS t FROM customer JOIN nation ON c_nationkey = n_nationkey), s AS (SELECT n_name AS store FROM nation WHERE n_regionkey < 3)
SELECT model, store FROM m LEFT JOIN s ON s.store = m.t
""")
def store_injections(spark, sf_dir):
    """Customers as models with their nation's name as parameter type; the nations of three regions are stores."""
    nation = read(spark, sf_dir, "nation")
    models = read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("model"), F.col("n_name").alias("parameter_type"))
    return program.store_injections(models, nation.where("n_regionkey < 3").select(F.col("n_name").alias("store")))


# ---------------------------------------------------------------- aggregates and merges


@query("""
WITH u AS (SELECT l_returnflag AS page, CASE WHEN l_linenumber = 1 THEN 'method' ELSE 'type' END AS kind, (l_orderkey * 100 + l_linenumber) * 10000000 + l_partkey AS ord, p_brand AS name FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT page, kind, string_agg(uid, ',' ORDER BY first) AS uids FROM (SELECT page, kind, kind || '_' || trim(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '_', 'g'), '_') AS uid, min(ord) AS first FROM u GROUP BY 1, 2, 3) GROUP BY 1, 2
""")
def provenance_seed(spark, sf_dir):
    """Brands of first items as methods, of further ones as types; return flags are pages."""
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    rows = rows.select(F.col("l_returnflag").alias("page"), F.when(F.col("l_linenumber") == 1, "method").otherwise("type").alias("kind"), ((F.col("l_orderkey") * 100 + F.col("l_linenumber")) * 10_000_000 + F.col("l_partkey")).alias("ord"), F.col("p_brand").alias("name"))
    rows = rows.groupBy("page", "kind", "name").agg(F.min("ord").alias("ord"))
    return program.provenance(rows, rows.limit(0)).withColumn("uids", F.array_join("uids", ","))


@query("""
SELECT p_partkey AS ord, 'pred_' || s || CASE WHEN n = 1 THEN '' ELSE '_' || n END AS predicate_uid, CASE WHEN p_size > 25 THEN p_type ELSE 'screen' END AS uids FROM (
  SELECT p_partkey, p_size, p_type, trim(regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '_', 'g'), '_') AS s, row_number() OVER (PARTITION BY trim(regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '_', 'g'), '_') ORDER BY p_partkey) AS n FROM part)
""")
def contract_bundle(spark, sf_dir):
    """Part types as predicates; those of large parts have a seed of their own, the others the screen's."""
    part = read(spark, sf_dir, "part")
    predicates = part.select(F.col("p_partkey").alias("ord"), F.col("p_type").alias("name"), "p_size")
    screen = part.limit(1).select(F.lit("__screen__").alias("name"), F.array(F.lit("screen")).alias("uids"))
    large = program.contract(predicates, screen.unionByName(part.select(F.col("p_type").alias("name"), F.array("p_type").alias("uids")).distinct()))
    small = program.contract(predicates, screen)
    own = large.where("p_size > 25").unionByName(small.where("p_size <= 25"))
    return own.select("ord", "predicate_uid", F.array_join("uids", ",").alias("uids"))


@query("SELECT conv_id AS window, string_agg(role, ',' ORDER BY turn) FILTER (WHERE contains(role, 'ass')) AS items, count(*) FILTER (WHERE contains(role, 'ass')) > 0 AS valid FROM conversations GROUP BY 1")
def compaction_window(spark, sf_dir):
    """Answers as compacted items."""
    items = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("window"), F.col("turn").alias("ord"), F.regexp_replace("role", "^assistant$", "compact:assistant").alias("type"))
    rows = program.compaction_window(items)
    return rows.select("window", F.nullif(F.array_join(F.transform("items", lambda x: F.regexp_replace(x, "^compact:", "")), ","), F.lit("")).alias("items"), "valid")


@query("""
WITH o AS (SELECT o_custkey AS page, o_orderpriority AS k, o_orderstatus AS v, o_orderkey AS n FROM orders), a AS (SELECT page, k, arg_max(v, n) AS v FROM o WHERE n % 2 = 0 GROUP BY 1, 2), b AS (SELECT page, k, arg_max(v, n) AS v FROM o WHERE n % 2 = 1 GROUP BY 1, 2),
m AS (SELECT coalesce(a.page, b.page) AS page, coalesce(a.k, b.k) AS k, coalesce(b.v, a.v) AS v FROM a FULL JOIN b ON a.page = b.page AND a.k = b.k)
SELECT page, string_agg(k || '=' || v, ',' ORDER BY k) AS outputs FROM m GROUP BY page
""")
def manifest_upsert(spark, sf_dir):
    """Customers as pages, priorities as variants: even orders as the old manifest, odd ones as the new."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderpriority").alias("k"), F.col("o_orderstatus").alias("v"), F.col("o_orderkey").alias("n"))

    def side(odd):
        last = o.where(F.col("n") % 2 == odd).groupBy("page", "k").agg(F.max_by("v", "n").alias("v"))
        return last.groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("outputs")).withColumn("fields", F.create_map().cast("map<string,string>"))

    merged = documents.merge_manifest(side(0), side(1))
    pairs = F.array_sort(F.transform(F.map_entries("outputs"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return merged.select("page", F.array_join(pairs, ",").alias("outputs"))


@query("SELECT CAST(greatest(max(conv_id), 0) + 1 AS BIGINT) AS page FROM conversations")
def next_page(spark, sf_dir):
    return documents.next_page(read(spark, sf_dir, "conversations").select(F.lit(None).cast("long").alias("page_count"), F.col("conv_id").alias("page")))


@query("""
WITH c AS (SELECT s_nationkey AS page, CAST(s_suppkey AS BIGINT) AS chunk, CAST(s_suppkey AS VARCHAR) AS ids, false AS synthetic FROM supplier)
SELECT * FROM c UNION ALL SELECT n_nationkey, 1, n_name, true FROM nation WHERE n_nationkey NOT IN (SELECT page FROM c)
""")
def empty_fallback(spark, sf_dir):
    """Nations as pages, suppliers as their chunks: a nation without any gets one empty chunk."""
    chunks = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("page"), F.col("s_suppkey").cast("long").alias("chunk"), F.array(F.col("s_suppkey").cast("string")).alias("resource_ids"), F.lit(False).alias("synthetic"))
    pages = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("page"), F.array("n_name").alias("resource_ids"))
    out = accumulate.with_fallback(chunks, pages)
    return out.select("page", "chunk", F.array_join("resource_ids", ",").alias("ids"), "synthetic")


@query("""
SELECT source, doc_id, n_chars, CAST(sum(n_chars) OVER w AS BIGINT) AS stop, CAST(sum(n_chars) OVER w AS BIGINT) - n_chars AS start FROM documents WHERE n_chars > 0 WINDOW w AS (PARTITION BY source ORDER BY doc_id)
""")
def chunk_offsets(spark, sf_dir):
    return pack.offsets(read(spark, sf_dir, "documents").select("source", "doc_id", "n_chars").where("n_chars > 0"), "source", "doc_id", "n_chars")


@query("""
SELECT l_orderkey AS page, string_agg('## ' || p_name || chr(10) || p_type || chr(10) || 'resources: ' || p_brand, chr(10) || chr(10) ORDER BY l_linenumber, l_partkey) AS blob FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
""")
def rendered_methods(spark, sf_dir):
    """Orders as pages, items as methods."""
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    methods = rows.select(F.col("l_orderkey").alias("page"), (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")).alias("ord"), F.col("p_name").alias("method"), F.col("p_type").alias("source_code"), F.array("p_brand").alias("resource_ids"))
    none = methods.limit(0).select("page", "ord", F.col("method").alias("type_full_name"), F.col("source_code").alias("body"))
    return render.method_blobs(methods, none, "v4")


@query(ORACLES["ordered_upsert"])
def streamed_state(spark, sf_dir):
    """ordered_upsert over the events as a stream: each batch's changed rows are written, the last of each key is the state."""
    folder = f"{graph.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    fields = read(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(fields).parquet(f"{sf_dir}/events.parque[t]")  # a pattern may be a file or a folder
    accumulate.start(stream, ["user_id", "event_type"], "event_id", ["props", "value"], f"{folder}/out", f"{folder}/state").awaitTermination()
    return accumulate.current(spark.read.parquet(f"{folder}/out"), ["user_id", "event_type"]).select("user_id", "event_type", "seen", "props", "value")


# ---------------------------------------------------------------- graphs


@query("""
WITH RECURSIVE w(node, ancestor, distance) AS (SELECT p_partkey, p_partkey // 2, 1 FROM part WHERE p_partkey > 1 UNION ALL SELECT node, ancestor // 2, distance + 1 FROM w WHERE ancestor > 1)
SELECT node, ancestor, distance FROM w
""")
def ancestors(spark, sf_dir):
    """Parts as a tree: part n hangs below part n / 2."""
    tree = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") > 1, F.expr("p_partkey div 2")).alias("parent"))
    return graph.ancestors(tree)


@query("""
WITH RECURSIVE w(node, ancestor, distance) AS (SELECT p_partkey, p_partkey // 2, 1 FROM part WHERE p_partkey > 1 UNION ALL SELECT node, ancestor // 2, distance + 1 FROM w WHERE ancestor > 1)
SELECT node, arg_min(ancestor, distance) AS ancestor FROM w JOIN part ON p_partkey = ancestor WHERE p_size >= 40 GROUP BY node
""")
def nearest_ancestor(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    tree = part.select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") > 1, F.expr("p_partkey div 2")).alias("parent"))
    return graph.nearest_ancestor(graph.ancestors(tree), part.withColumnRenamed("p_partkey", "node"), F.col("p_size") >= 40)


@query(f"""
WITH RECURSIVE {EVENT_GRAPH}, w(root, node, depth, path) AS (SELECT event_id, event_id, 0, [event_id] FROM events WHERE event_type = 'view' UNION ALL SELECT root, g.dst, depth + 1, list_append(path, g.dst) FROM w JOIN g ON g.src = w.node WHERE depth < 4)
SELECT root, value, depth FROM (SELECT root, w.depth, event_type AS value, row_number() OVER (PARTITION BY root ORDER BY depth, path) AS r FROM w JOIN events ON event_id = node WHERE event_type IN ('purchase', 'signup')) WHERE r = 1
""")
def alias_values(spark, sf_dir):
    """What the views stand for: the nearest purchase or signup within four steps."""
    nodes, edges = event_graph(spark, sf_dir)
    values = nodes.where("event_type in ('purchase', 'signup')").select("node", F.col("event_type").alias("value"))
    return graph.first_value(nodes.where("event_type = 'view'").select(F.col("node").alias("root")), edges, values, 4)


@query(f"""
WITH {EVENT_GRAPH}, k AS (SELECT g.*, row_number() OVER (PARTITION BY src ORDER BY dst) AS n, count(*) OVER (PARTITION BY src) AS many, event_type FROM g JOIN events ON event_id = src)
SELECT method, src, dst, CASE WHEN many = 1 THEN '' WHEN event_type = 'click' AND n = 1 THEN 'true' WHEN event_type = 'click' THEN 'false' ELSE 'branch_' || n END AS label FROM k
""")
def edge_labels(spark, sf_dir):
    """Clicks as conditions."""
    nodes, edges = event_graph(spark, sf_dir)
    blocks = nodes.select("method", F.col("node").alias("block"), F.when(F.col("event_type") == "click", "condition").otherwise("other").alias("kind"), F.col("line").alias("first_line"))
    return cfg.edge_labels(edges, blocks)


@query("""
WITH RECURSIVE i AS (SELECT DISTINCT p.page_id AS src, q.page_id AS dst FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) p JOIN pages q ON q.url = p.href),
w(root, layout, depth) AS (SELECT page_id, page_id, 0 FROM pages UNION SELECT root, dst, depth + 1 FROM w JOIN i ON i.src = layout WHERE depth < 3)
SELECT root, layout, min(depth) AS depth FROM w GROUP BY 1, 2
""")
def included_layouts(spark, sf_dir):
    """Pages include the pages that they link to."""
    pages = read(spark, sf_dir, "pages")
    links = pages.select(F.col("page_id").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("url")).join(pages.select(F.col("page_id").alias("dst"), "url"), "url")
    return program.included_layouts(links, pages.select(F.col("page_id").alias("root")), 3)


@query("""
SELECT user_id, event_type, kind, code FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY CASE kind WHEN 'LISTENER' THEN 0 WHEN 'SETTER' THEN 2 WHEN 'GETTER' THEN 3 ELSE 4 END, length(code) DESC, ord) AS r FROM (
  SELECT event_id, user_id, event_type, event_id AS ord, 'SETTER' AS kind, 'x.' || event_type AS code FROM events UNION ALL SELECT event_id, user_id, event_type, event_id + 1, 'LISTENER', event_type FROM events WHERE user_id % 2 = 0)) WHERE r = 1
""")
def usage_of_node(spark, sf_dir):
    """Every event as a setter, those of even users also as a listener: the stronger kind stays."""
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("node_id"), "user_id", "event_type", F.col("event_id").alias("ord"), F.lit("F").alias("file"), F.lit(1).alias("line"))
    rows = e.withColumns({"kind": F.lit("SETTER"), "code": F.concat(F.lit("x."), "event_type")})
    rows = rows.unionByName(e.where("user_id % 2 = 0").withColumns({"kind": F.lit("LISTENER"), "code": F.col("event_type"), "ord": F.col("ord") + 1}))
    return ranked.java_usages(rows).select("user_id", "event_type", "kind", "code")


@query("""
SELECT p_brand AS p, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) FILTER (WHERE true) AS types, count(DISTINCT p_type) AS n FROM part GROUP BY 1
""")
def limited_lists(spark, sf_dir):
    """A brand's types, at most twelve of them written out (there are fewer)."""
    rows = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("p")).agg(F.collect_set("p_type").alias("t"))
    return rows.select("p", render.limited(F.col("t")).alias("types"), F.size("t").cast("long").alias("n"))


@query("""
WITH r AS (SELECT event_id AS request_id, event_type AS prompt FROM events), a AS (SELECT sha256(event_type) AS digest, upper(event_type) AS answer FROM (SELECT DISTINCT event_type FROM events WHERE event_type <> 'error'))
SELECT request_id, answer FROM r LEFT JOIN a ON a.digest = sha256(r.prompt)
""")
def recorded_calls(spark, sf_dir):
    """Event types as prompts; all but errors have a recorded answer."""
    e = read(spark, sf_dir, "events")
    answers = e.where("event_type <> 'error'").select("event_type").distinct().select(F.sha2("event_type", 256).alias("digest"), F.upper("event_type").alias("answer"))
    return accumulate.recorded(e.select(F.col("event_id").alias("request_id"), F.col("event_type").alias("prompt")), answers).select("request_id", "answer")


@query("""
SELECT p_partkey AS ord, coalesce(nullif(trim(CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END), ''), nullif(trim(CASE WHEN p_size % 2 = 0 THEN ' ' ELSE p_brand END), ''), p_type) AS name,
  CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN 'DIRECT_USAGE' WHEN p_size % 5 = 2 THEN 'ASSIGNMENT' ELSE 'CHAINING' END AS usage_type FROM part
""")
def anchor_names(spark, sf_dir):
    """First name that isn't blank, and usage types from roles and nodes."""
    name = text.first_non_blank(F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_name")), F.when(F.col("p_size") % 2 == 0, " ").otherwise(F.col("p_brand")), "p_type")
    five = F.col("p_size") % 5
    role = F.when(five == 0, "").when(five == 1, "USAGE").otherwise("HANDLE")
    kind = classify.usage_type(F.lit(None).cast("string"), role, F.when(five == 2, "1").otherwise("2"), F.lit("2"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), name.alias("name"), kind.alias("usage_type"))


@query("""
WITH d AS (SELECT lower(trim(p_brand)) AS a, lower(trim(p_type)) AS b, bool_or(p_size <= 10) AS l, bool_or(p_size >= 45) AS r FROM part GROUP BY 1, 2)
SELECT * FROM (SELECT concat_ws(chr(10) || chr(10), 'Missing:' || chr(10) || string_agg(a || '.' || b, chr(10) ORDER BY a || '.' || b) FILTER (WHERE l AND NOT r), 'Unexpected:' || chr(10) || string_agg(a || '.' || b, chr(10) ORDER BY a || '.' || b) FILTER (WHERE r AND NOT l)) AS text FROM d) WHERE text <> ''
""")
def difference_question(spark, sf_dir):
    part = read(spark, sf_dir, "part").select(F.col("p_brand").alias("a"), F.col("p_type").alias("b"), "p_size")
    return render.difference_question(merge.key_difference(part.where("p_size <= 10"), part.where("p_size >= 45"), ["a", "b"]), ["a", "b"])


@query("""
WITH f AS (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations)
SELECT conv_id AS resource, count(*) AS n_turns, count(nxt) AS n_calls, count(DISTINCT role) AS n_roles FROM f GROUP BY 1
""")
def evidence_edges(spark, sf_dir):
    """Conversations as resources, turns as methods, roles as types: vertices and edges of the index."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lead("role").over(w).alias("nxt"))
    occurrences = rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.col("conv_id").alias("resource"), F.concat_ws(":", "conv_id", "turn").alias("method"), F.col("role").alias("type"))
    index = evidence.evidence_index(occurrences)
    turns = index["resource_method"].groupBy("resource").agg(F.count("*").alias("n_turns"))
    roles = index["resource_type"].groupBy("resource").agg(F.count("*").alias("n_roles"))
    calls = rows.groupBy(F.col("conv_id").alias("resource")).agg(F.count("nxt").alias("n_calls"))
    return turns.join(roles, "resource").join(calls, "resource")
