"""Every operator applied to the driver's tables. The docstring of a query says which table plays which part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions import classify, text
from weft.operators import cfg, evidence, graph, merge, pack, ranked, render, resolve
from weft.streaming import accumulate

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- scalar functions


@query("""
SELECT p_partkey, 'part_' || substr(sha1(coalesce(p_brand, '') || '||' || coalesce(p_type, '') || '||' || coalesce(CAST(p_size AS VARCHAR), '')), 1, 12) AS uid FROM part
""")
def stable_uid(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", text.stable_uid("part", "p_brand", "p_type", "p_size").alias("uid"))


@query("""
SELECT DISTINCT value, CASE WHEN s = '' THEN 'unknown' ELSE s END AS slug, k AS norm_key FROM (
  SELECT value, trim(regexp_replace(lower(trim(value)), '[^a-z0-9]+', '_', 'g'), '_') AS s, regexp_replace(lower(trim(value)), '[^a-z0-9]+', '', 'g') AS k
  FROM (SELECT p_name AS value FROM part UNION ALL SELECT p_type FROM part UNION ALL SELECT event_type FROM events UNION ALL SELECT o_orderpriority FROM orders))
""")
def slug_norm_keys(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    values = part.select(F.col("p_name").alias("value")).unionAll(part.select("p_type")).unionAll(read(spark, sf_dir, "events").select("event_type")).unionAll(read(spark, sf_dir, "orders").select("o_orderpriority"))
    return values.distinct().select("value", text.slug("value").alias("slug"), text.norm_key("value").alias("norm_key"))


@query("""
SELECT event_type, upper(event_type) AS kind, CASE WHEN event_type IN ('click', 'purchase') THEN 'write' WHEN event_type = 'view' THEN 'read' WHEN event_type = 'signup' THEN 'sink' ELSE 'unknown' END AS evidence_kind,
  count(*) AS n FROM events GROUP BY 1, 2, 3
""")
def evidence_kinds(spark, sf_dir):
    """Event types as usage kinds: click and purchase write, view reads, signup listens."""
    usage = F.when(F.col("event_type").isin("click", "purchase"), "SETTER").when(F.col("event_type") == "view", "GETTER").when(F.col("event_type") == "signup", "LISTENER")
    rows = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return rows.select("event_type", F.upper("event_type").alias("kind"), classify.evidence_kind(usage).alias("evidence_kind"), "n")


@query("""
WITH f AS (SELECT p_name, t AS token FROM part, unnest(string_split(p_name, ' ')) u(t) WHERE t <> ''), c AS (
  SELECT DISTINCT token, lower(token) AS n FROM f)
SELECT token, CASE WHEN starts_with(n, 'set') THEN 'SETTER' WHEN regexp_matches(n, '^(on|init|create|build|calculate|compute|fetch|load|parse|decode|encode)') THEN NULL
  WHEN regexp_matches(n, '^(get|is|has)') THEN 'GETTER' WHEN regexp_matches(n, '^(add|remove|clear|delete|insert|show|hide|dismiss|close|open|collapse|expand|toggle|request|perform|post|send|invalidate|refresh|update|redraw|animate|start|stop|pause|resume)') THEN 'SETTER'
  ELSE 'OTHER' END AS signal FROM c
""")
def call_signals(spark, sf_dir):
    """Words of part names as names of calls."""
    words = read(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("token")).where("token <> ''").distinct()
    return words.select("token", classify.call_signal("token").alias("signal"))


@query("""
SELECT event_id, attempt, status, status IN (408, 409, 429, 520, 522, 524) OR status >= 500 AS again,
  least(30.0 * pow(2.0, attempt - 1), 120.0) AS wait FROM (SELECT event_id, CAST(event_id % 5 + 1 AS INTEGER) AS attempt, CAST(400 + user_id % 130 AS INTEGER) AS status FROM events)
""")
def retry_backoff(spark, sf_dir):
    """Events as attempts, users as statuses."""
    rows = read(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 5 + 1).cast("int").alias("attempt"), (400 + F.col("user_id") % 130).cast("int").alias("status"))
    again = text.retryable(F.lit(None).cast("string"), "status")
    return rows.select("event_id", "attempt", "status", again.alias("again"), text.backoff("attempt", 30.0, 120.0).alias("wait"))


@query("""
SELECT p_partkey, CASE WHEN n = 1 THEN s ELSE s || '_' || n END AS uid FROM (
  SELECT p_partkey, s, row_number() OVER (PARTITION BY s ORDER BY p_partkey) AS n FROM (
    SELECT p_partkey, trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g'), '_') AS s FROM part))
""")
def uid_collision_suffix(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", text.slug("p_name", "unnamed").alias("s"))
    return rows.select("p_partkey", text.suffixed(F.col("s"), "p_partkey").alias("uid"))


@query("""
SELECT DISTINCT page_id, h AS href FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM pages) WHERE h <> ''
""")
def a11y_ids(spark, sf_dir):
    """Links of web pages in the place of resource ids of screens."""
    found = read(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return found.where("href <> ''").distinct()


# ---------------------------------------------------------------- ranked deduplication


@query("""
SELECT l_orderkey, l_suppkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem) WHERE r = 1
""")
def top1_dedup(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    return ranked.top1(rows, ["l_orderkey", "l_suppkey"], [F.desc("l_extendedprice"), F.col("l_linenumber")])


@query("""
SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY
  CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 WHEN 'F' THEN 2 ELSE 3 END, o_orderpriority, o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1
""")
def canonical_rank(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    order = [ranked.ranks(F.col("o_orderstatus"), ["O", "P", "F"]), F.col("o_orderpriority"), F.desc("o_totalprice"), F.col("o_orderkey")]
    return ranked.top1(rows, ["o_custkey"], order).drop("o_totalprice")


@query("""
WITH a AS (SELECT event_id, user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type, date_trunc('hour', ts) ORDER BY value DESC, event_id) AS r FROM events),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, value ORDER BY event_id) AS q FROM a WHERE r = 1)
SELECT event_id, user_id, event_type, value FROM b WHERE q = 1
""")
def cross_group_dedup(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.date_trunc("hour", "ts").alias("hour"))
    best = ranked.top1(rows, ["user_id", "event_type", "hour"], [F.desc("value"), F.col("event_id")])
    return ranked.top1(best, ["user_id", "event_type", "value"], [F.col("event_id")]).drop("hour")


@query("""
WITH n AS (SELECT DISTINCT l.s_nationkey AS k, t FROM supplier l, unnest([s_name, substr(s_name, 1, 12), substr(s_name, 3, 9), substr(s_name, 10)]) u(t) WHERE length(t) > 0)
SELECT k AS nation, t AS name FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE b.k = a.k AND length(b.t) > length(a.t) AND contains(b.t, a.t))
""")
def containment_antijoin(spark, sf_dir):
    """Supplier names and pieces of them as code lines of a nation: what lies in a longer one of the nation goes."""
    name = F.col("s_name")
    pieces = F.array(name, F.substr(name, F.lit(1), F.lit(12)), F.substr(name, F.lit(3), F.lit(9)), F.substr(name, F.lit(10)))
    rows = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.explode(pieces).alias("name")).where("length(name) > 0").distinct()
    return ranked.not_contained(rows, ["nation"], "name")


@query("""
SELECT (SELECT count(*) FROM part) AS n_total, (SELECT count(DISTINCT p_name) FROM part) AS n_names, (SELECT count(DISTINCT p_type) FROM part) AS n_kinds,
  count(*) FILTER (WHERE n > 1) AS n_duplicate_names, max(n) AS max_declared FROM (SELECT p_name, count(*) AS n FROM part GROUP BY p_name)
""")
def inventory_summary(spark, sf_dir):
    return evidence.inventory_summary(read(spark, sf_dir, "part"), "p_name", "p_type")


# ---------------------------------------------------------------- joins in tiers


@query("""
WITH one AS (SELECT s_nationkey, min(s_suppkey) AS k FROM supplier GROUP BY 1 HAVING count(*) = 1),
reg AS (SELECT n_regionkey, min(s_suppkey) AS k, count(*) > 1 AS several FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
SELECT c_custkey, coalesce(e.s_suppkey, one.k, reg.k) AS supplier, CASE WHEN e.s_suppkey IS NOT NULL THEN 1 WHEN one.k IS NOT NULL THEN 2 WHEN reg.k IS NOT NULL THEN 3 END AS tier,
  e.s_suppkey IS NULL AND one.k IS NULL AND coalesce(reg.several, false) AS ambiguous
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN supplier e ON e.s_nationkey = c_nationkey AND e.s_suppkey = c_custkey
LEFT JOIN one ON one.s_nationkey = c_nationkey LEFT JOIN reg ON reg.n_regionkey = nation.n_regionkey
""")
def tiered_resolve(spark, sf_dir):
    """A customer's supplier: same nation and key, else the nation's only one, else the first of the region."""
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("v"), F.col("s_nationkey").alias("nation"))
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("key")).join(nation, "nation", "left")
    by_region = s.join(nation, "nation").groupBy("region").agg(F.min("v").alias("v"), (F.count("*") > 1).alias("several"))
    out = resolve.tiered(c, [(s.withColumn("key", F.col("v")), ["nation", "key"]), (resolve.unique_by(s, ["nation"], "v"), ["nation"]), (by_region, ["region"])], "v", "supplier")
    out = out.join(by_region.select("region", "several"), "region", "left")
    return out.select("c_custkey", "supplier", "tier", (F.coalesce(F.col("tier") == 3, F.lit(False)) & F.coalesce("several", F.lit(False))).alias("ambiguous"))


@query("""
WITH h AS (SELECT DISTINCT h AS href FROM (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM pages) WHERE h <> ''),
p AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/]+(/.*)$', 1) AS path FROM pages),
m AS (SELECT href, page_id, 1 AS tier FROM h JOIN p ON p.url = href UNION ALL SELECT href, page_id, 2 FROM h JOIN p ON p.path = regexp_replace(href, '^[a-z]+://[^/]+', '') AND p.path <> ''),
b AS (SELECT *, min(tier) OVER (PARTITION BY href) AS low FROM m)
SELECT href, min(page_id) AS page_id, tier, count(*) AS n FROM b WHERE tier = low GROUP BY href, tier
UNION ALL SELECT href, NULL, 4, 1 FROM h WHERE href NOT IN (SELECT href FROM m)
""")
def ref_cascade(spark, sf_dir):
    """Links resolved to pages: by url, else by path without its host, else a row without a page."""
    pages = read(spark, sf_dir, "pages")
    refs = pages.select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")).where("href <> ''").distinct()
    by_url = refs.join(pages.select("page_id", F.col("url").alias("href")), "href").withColumn("tier", F.lit(1))
    path = pages.select("page_id", F.regexp_extract("url", "^[a-z]+://[^/]+(/.*)$", 1).alias("path")).where("path <> ''")
    by_path = refs.withColumn("path", F.regexp_replace("href", "^[a-z]+://[^/]+", "")).join(path, "path").select("href", "page_id", F.lit(2).alias("tier"))
    found = resolve.lowest_tier(by_url.unionByName(by_path), ["href"]).groupBy("href", "tier").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))
    none = refs.join(found, "href", "left_anti").select("href", F.lit(4).alias("tier"), F.lit(None).cast("long").alias("page_id"), F.lit(1).cast("long").alias("n"))
    return found.unionByName(none)


@query("""
WITH c AS (SELECT DISTINCT regexp_extract(url, '^([a-z]+://[^/]+/[^/]*)', 1) AS prefix FROM pages)
SELECT DISTINCT url, prefix FROM pages JOIN c ON starts_with(url, prefix) AND length(url) > length(prefix) AND prefix <> ''
""")
def prefix_theta_join(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    return resolve.prefixes(pages, "url", pages.select(F.regexp_extract("url", "^([a-z]+://[^/]+/[^/]*)", 1).alias("prefix")), "prefix")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45)")
def semi_visible(spark, sf_dir):
    seen = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity >= 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(seen, "o_orderkey", "left_semi")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def anti_refs(spark, sf_dir):
    there = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(there, "o_orderkey", "left_anti")


# ---------------------------------------------------------------- merges


@query("""
WITH l AS (SELECT DISTINCT lower(trim(p_brand)) AS brand, lower(trim(p_type)) AS type FROM part WHERE p_size <= 10), r AS (SELECT DISTINCT lower(trim(p_brand)) AS brand, lower(trim(p_type)) AS type FROM part WHERE p_size >= 45)
SELECT coalesce(l.brand, r.brand) AS brand, coalesce(l.type, r.type) AS type, CASE WHEN r.brand IS NULL THEN 'FN' WHEN l.brand IS NULL THEN 'FP' ELSE 'TP' END AS side FROM l FULL JOIN r ON l.brand = r.brand AND l.type = r.type
""")
def fpfn_diff(spark, sf_dir):
    """Brands and types of small parts as truth, of large parts as what was found."""
    part = read(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), "p_size")
    return merge.key_difference(part.where("p_size <= 10"), part.where("p_size >= 45"), ["brand", "type"])


@query("""
SELECT conv_id, count(*) AS n_kept, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS turns FROM conversations c
WHERE NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = conv_id AND turn = toxic + 1 AND quality = 0) GROUP BY conv_id
""")
def monotone_drop(spark, sf_dir):
    """Labels as verdicts on turns: quality 0 drops turn toxic + 1; without a verdict a turn stays, without turns a conversation goes."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn")
    verdicts = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("conv_id"), (F.col("toxic") + 1).cast("long").alias("turn"), F.when(F.col("quality") == 0, "drop").otherwise("keep").alias("verdict"))
    kept = merge.monotone_decrease(turns, verdicts, ["conv_id", "turn"])
    return kept.groupBy("conv_id").agg(F.count("*").alias("n_kept"), F.array_join(F.transform(F.sort_array(F.collect_list("turn")), lambda t: t.cast("string")), ",").alias("turns"))


@query("""
WITH c AS (SELECT DISTINCT conv_id, turn FROM conversations), v AS (SELECT quality, toxic, CASE WHEN quality = 0 THEN 'drop' ELSE 'keep' END AS verdict, c.conv_id IS NOT NULL AS ok FROM labels LEFT JOIN c ON c.conv_id = doc_id AND c.turn = toxic + 1)
SELECT toxic, count(*) FILTER (WHERE ok AND verdict = 'drop') AS n_drop, count(*) FILTER (WHERE ok AND verdict = 'keep') AS n_keep, count(*) FILTER (WHERE NOT ok) AS n_invalid FROM v GROUP BY toxic
""")
def verdict_union(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn")
    verdicts = read(spark, sf_dir, "labels").select("toxic", F.col("doc_id").alias("conv_id"), (F.col("toxic") + 1).cast("long").alias("turn"), F.when(F.col("quality") == 0, "drop").otherwise("keep").alias("verdict"))
    return merge.verdict_counts(verdicts, turns, ["conv_id", "turn"], ["toxic"])


@query("""
SELECT user_id, event_type, min(event_id) AS seen, arg_max(props, event_id) FILTER (WHERE trim(props) <> '') AS props, arg_max(value, event_id) FILTER (WHERE value IS NOT NULL) AS value FROM events GROUP BY 1, 2
""")
def ordered_upsert(spark, sf_dir):
    return merge.ordered_upsert(read(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id", ["props", "value"])


CUMULATIVE = """
WITH f AS (SELECT {key}, min({step}) AS step FROM {source} GROUP BY {key}), n AS (SELECT step, count(*) AS n_new FROM f GROUP BY 1), s AS (SELECT DISTINCT {step} AS step FROM {source}),
a AS (SELECT s.step, coalesce(n_new, 0) AS n_new FROM s LEFT JOIN n USING (step))
"""


@query(CUMULATIVE.format(key="user_id, event_type, props", step="CAST(ts AS DATE)", source="events") + "SELECT CAST(step AS VARCHAR) AS day, n_new, CAST(sum(n_new) OVER (ORDER BY step) AS BIGINT) AS n_total FROM a")
def cumulative_state(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return accumulate.running_keys(rows, "day", ["user_id", "event_type", "props"])


@query(CUMULATIVE.format(key="lang, n_chars", step="source", source="documents") + "SELECT step AS source, n_new, CAST(sum(n_new) OVER (ORDER BY step) AS BIGINT) - n_new AS before, CAST(sum(n_new) OVER (ORDER BY step) AS BIGINT) AS after FROM a")
def chunk_merge_counts(spark, sf_dir):
    """Sources as chunks, (language, length) as predicates: how many there are before and after each chunk."""
    return merge.running_distinct(read(spark, sf_dir, "documents").select("source", "lang", "n_chars"), "source", ["lang", "n_chars"])


@query("""
WITH k AS (SELECT *, regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '', 'g') AS a, regexp_replace(lower(trim(p_brand)), '[^a-z0-9]+', '', 'g') AS b FROM part)
SELECT a AS key_p, b AS key_v, min(p_partkey) AS ord, arg_min(p_name, p_partkey) AS predicate, arg_min(p_brand, p_partkey) AS variable, arg_min(p_type, p_partkey) AS type, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS chunks, count(*) AS n FROM k GROUP BY 1, 2
""")
def candidate_dedup(spark, sf_dir):
    """Part names and brands as candidates."""
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("predicate"), F.col("p_brand").alias("variable"), F.col("p_type").alias("type"), F.lit("").alias("description"), F.col("p_partkey").cast("string").alias("chunk_id"))
    kept, _ = merge.candidates(rows)
    return kept.select("key_p", "key_v", "ord", "predicate", "variable", "type", F.array_join("chunks", ",").alias("chunks"), "n")


@query("""
WITH f AS (SELECT p_name AS predicate, p_brand AS variable, min(p_partkey) AS ord FROM part GROUP BY regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '', 'g'), regexp_replace(lower(trim(p_brand)), '[^a-z0-9]+', '', 'g'), 1, 2)
SELECT predicate, min(ord) AS ord, string_agg(variable, ',' ORDER BY ord) AS variables FROM f GROUP BY predicate
""")
def regrouped_variables(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("predicate"), F.col("p_brand").alias("variable"), F.col("p_type").alias("type"), F.lit("").alias("description"), F.lit("").alias("chunk_id"))
    return merge.regrouped(merge.candidates(rows)[0]).withColumn("variables", F.array_join("variables", ","))


@query("""
SELECT l_returnflag, count(*) AS n_requests, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS prompt, CAST(sum(CAST(l_linenumber AS BIGINT)) AS BIGINT) AS cached,
  round(sum(CAST(l_linenumber AS BIGINT)) / sum(CAST(l_quantity AS BIGINT)), 9) AS cache_hit_rate FROM lineitem GROUP BY l_returnflag
""")
def usage_rollup(spark, sf_dir):
    """Quantities as prompt tokens, line numbers as cached ones."""
    rows = read(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("long").alias("prompt"), F.col("l_linenumber").cast("long").alias("cached"))
    return merge.usage_rollup(rows, ["l_returnflag"], "prompt", "cached", ["prompt", "cached"]).withColumn("cache_hit_rate", F.round("cache_hit_rate", 9))


@query("""
SELECT c.chunk_id, c.cache_key, e.output, e.output IS NOT NULL AS reused FROM (SELECT CAST(p_partkey AS VARCHAR) AS chunk_id, p_brand AS cache_key FROM part) c LEFT JOIN (
  SELECT CAST(p_partkey AS VARCHAR) AS chunk_id, p_brand AS cache_key, p_name AS output FROM part WHERE p_size % 3 <> 0 AND p_retailprice > 1000) e USING (chunk_id, cache_key)
""")
def resume_reuse(spark, sf_dir):
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("chunk_id"), F.col("p_brand").alias("cache_key"), F.col("p_name").alias("output"), F.col("p_partkey").alias("ord"), (F.col("p_size") % 3 == 0).alias("failed"), F.when(F.col("p_retailprice") > 1000, 1).otherwise(0).alias("n_definitions"))
    return merge.reusable(part.select("chunk_id", "cache_key"), part)


# ---------------------------------------------------------------- indexes


@query("SELECT n_name, string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey) AS suppliers FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
def inverse_index(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = s.select(F.array("n_name").alias("names"), F.col("s_suppkey").alias("supplier"))
    return evidence.inverse_index(rows.withColumn("ord", F.col("supplier")), "n_name", "names", "supplier", "ord").withColumn("suppliers", F.array_join(F.transform("suppliers", lambda x: x.cast("string")), ","))


@query("""
SELECT DISTINCT role AS method, nxt AS callee FROM (SELECT role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE nxt IS NOT NULL
""")
def direct_callees(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = read(spark, sf_dir, "conversations").select(F.col("role").alias("method"), F.filter(F.array("role", F.lead("role").over(w)), lambda x: x.isNotNull()).alias("path"))
    return evidence.direct_callees(rows, "method", "path")


@query("""
WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, min(event_id) AS ord, string_agg(event_type, '>' ORDER BY event_id) AS path, arg_min(event_type, event_id) AS root FROM events GROUP BY 1, 2)
SELECT root, path, min(ord) AS first, count(*) AS n FROM s GROUP BY 1, 2
""")
def call_path_overview(spark, sf_dir):
    """A user's events of a day as a call path."""
    rows = read(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(evidence.ordered("event_type", "event_id", distinct=False).alias("p"), F.min("event_id").alias("ord"))
    rows = rows.select(F.get("p", F.lit(0)).alias("root"), F.array_join("p", ">").alias("path"), "ord")
    return evidence.path_overview(rows, "root", "path", "ord")


@query("""
SELECT l_partkey AS part, count(DISTINCT l_suppkey) AS n_chunks, max(length(p_name)) AS chars, max(length(p_name)) * (count(DISTINCT l_suppkey) - 1) AS duplicated_chars FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1
""")
def dup_report(spark, sf_dir):
    """Parts that several suppliers deliver: suppliers are chunks."""
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("chunk"), F.length("p_name").alias("chars"))
    return evidence.duplicated(rows, "part", "chunk", "chars")


@query("""
WITH e AS (SELECT DISTINCT l_partkey AS part, l_suppkey AS supplier FROM lineitem), c AS (SELECT p_partkey AS node FROM part WHERE p_size = 7), d AS (SELECT s_suppkey AS node FROM supplier WHERE s_acctbal < 0)
SELECT part, supplier FROM e WHERE part IN (SELECT node FROM c) AND supplier IN (SELECT node FROM d)
""")
def edge_select(spark, sf_dir):
    edges = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")).distinct()
    parts = read(spark, sf_dir, "part").where("p_size = 7").select(F.col("p_partkey").alias("part"))
    suppliers = read(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("supplier"))
    return edges.join(parts, "part", "left_semi").join(suppliers, "supplier", "left_semi")


@query("""
WITH o AS (SELECT n_name AS resource, o_orderkey AS method, p_type AS type FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)
SELECT kind, n_unique, n_occurrences, greatest(n_occurrences - n_unique, 0) AS avoided FROM (SELECT 'method' AS kind, count(DISTINCT method) AS n_unique, count(*) AS n_occurrences FROM o UNION ALL SELECT 'type', count(DISTINCT type), count(*) FROM o)
""")
def evidence_index(spark, sf_dir):
    """Nations as resources, orders as methods, part types as types."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").join(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    rows = rows.join(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").join(read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    rows = rows.join(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    occurrences = rows.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ord"), F.col("n_name").alias("resource"), F.col("l_orderkey").alias("method"), F.col("p_type").alias("type"))
    return evidence.evidence_index(occurrences)["stats"]


@query("""
WITH t AS (SELECT item_id, arg_max(w, (length(w), w)) AS token FROM (SELECT item_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM benchmark) GROUP BY 1),
d AS (SELECT DISTINCT doc_id, w AS token FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM documents))
SELECT item_id, token, count(doc_id) AS n_documents, min(doc_id) AS first_document FROM t LEFT JOIN d USING (token) GROUP BY 1, 2
""")
def attribution(spark, sf_dir):
    """The longest word of each benchmark item, and the documents that name it."""
    words = lambda df, key: df.select(key, F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("token"))
    tokens = words(read(spark, sf_dir, "benchmark"), "item_id").groupBy("item_id").agg(F.max_by("token", F.struct(F.length("token").alias("n"), "token")).alias("token"))
    named = words(read(spark, sf_dir, "documents"), "doc_id").join(tokens.select("token").distinct(), "token", "left_semi").distinct()
    return tokens.join(named, "token", "left").groupBy("item_id", "token").agg(F.count("doc_id").alias("n_documents"), F.min("doc_id").alias("first_document"))


@query("""
WITH l AS (SELECT page_id, generate_subscripts(p, 1) AS line, unnest(p) AS code FROM (SELECT page_id, string_split(html, '>') AS p FROM pages)),
o AS (SELECT page_id, line, CAST(regexp_matches(code, '<div') AS BIGINT) AS opens, CAST(regexp_matches(code, '</div') AS BIGINT) AS closes FROM l),
r AS (SELECT page_id, line, sum(opens - closes) OVER w AS depth, sum(opens) OVER w AS opened FROM o WINDOW w AS (PARTITION BY page_id ORDER BY line))
SELECT page_id, min(line) FILTER (WHERE opened > 0 AND depth <= 0) AS last, CAST(max(depth) AS BIGINT) AS max_depth, max(line) AS n_lines FROM r GROUP BY page_id
""")
def balanced_extent(spark, sf_dir):
    """Tags of web pages: where the first div is closed again."""
    rows = read(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split("html", ">")).alias("n", "code")).withColumn("line", (F.col("n") + 1).cast("long"))
    return evidence.balanced_extent(rows, "page_id", "line", F.col("code").rlike("<div").cast("long"), F.col("code").rlike("</div").cast("long"))


# ---------------------------------------------------------------- graphs


#: Events as methods: an event calls the user's next one, and a click also the user's next purchase.
EVENT_GRAPH = """
e AS (SELECT event_id, user_id, event_type, lead(event_id) OVER u AS nxt, min(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS buy FROM events WINDOW u AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT DISTINCT * FROM (SELECT user_id AS method, event_id AS src, nxt AS dst FROM e WHERE nxt IS NOT NULL UNION ALL SELECT user_id, event_id, buy FROM e WHERE buy IS NOT NULL AND event_type = 'click'))
"""


def event_graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    w = Window.partitionBy("user_id").orderBy("event_id")
    later = w.rowsBetween(1, Window.unboundedFollowing)
    e = events.withColumns({"nxt": F.lead("event_id").over(w), "buy": F.min(F.when(F.col("event_type") == "purchase", F.col("event_id"))).over(later)})
    edges = e.where("nxt is not null").select(F.col("user_id").alias("method"), F.col("event_id").alias("src"), F.col("nxt").alias("dst"))
    edges = edges.unionByName(e.where("buy is not null and event_type = 'click'").select(F.col("user_id").alias("method"), F.col("event_id").alias("src"), F.col("buy").alias("dst")))
    return events.select(F.col("user_id").alias("method"), F.col("event_id").alias("node"), F.col("event_id").alias("line"), "event_type"), edges.distinct()


@query(f"""
WITH RECURSIVE {EVENT_GRAPH}, d AS (SELECT event_id FROM events WHERE event_type <> 'error'),
w(root, node, depth, path) AS (SELECT event_id, event_id, 0, [event_id] FROM events WHERE event_type = 'signup'
  UNION ALL SELECT root, g.dst, depth + 1, list_append(path, g.dst) FROM w JOIN g ON g.src = w.node JOIN d ON d.event_id = g.dst WHERE depth < 5 AND NOT list_contains(path, g.dst))
SELECT root, node, depth, array_to_string(path, '/') AS path FROM (SELECT *, row_number() OVER (PARTITION BY root, node ORDER BY depth, path) AS r FROM w WHERE depth > 0) WHERE r = 1
""")
def forward_closure(spark, sf_dir):
    """What each signup leads to within five calls, past everything but errors."""
    nodes, edges = event_graph(spark, sf_dir)
    roots = nodes.where("event_type = 'signup'").select(F.col("node").alias("root"))
    found = graph.forward_closure(roots, edges, nodes.select("node", (F.col("event_type") != "error").alias("domain")))
    return found.withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), "/"))


# Every path to a purchase runs forward through the purchases between, so from a click the shortest one jumps to the next purchase.
@query(f"""
WITH RECURSIVE {EVENT_GRAPH}, h AS (SELECT event_id AS src, CASE WHEN event_type = 'click' THEN coalesce(buy, nxt) ELSE nxt END AS dst FROM e WHERE event_type <> 'error'),
w(root, node, depth, path) AS (SELECT event_id, event_id, 0, [event_id] FROM events WHERE event_type = 'purchase'
  UNION ALL SELECT root, h.src, depth + 1, list_prepend(h.src, path) FROM w JOIN h ON h.dst = w.node)
SELECT root, node AS callback, event_type AS kind, CASE depth WHEN 0 THEN 'SELF' ELSE 'CALLER_CHAIN' END AS relation, depth, array_to_string(path, '/') AS path
FROM w JOIN events ON event_id = node WHERE event_type IN ('click', 'signup')
""")
def backward_paths(spark, sf_dir):
    """The clicks and signups that lead to each purchase, over any number of calls."""
    nodes, edges = event_graph(spark, sf_dir)
    primaries = nodes.where("event_type = 'purchase'").select(F.col("node").alias("root"))
    kinds = nodes.select("node", F.when(F.col("event_type").isin("click", "signup"), F.col("event_type")).alias("callback_kind"), (F.col("event_type") == "error").alias("framework"))
    found = graph.backward_callbacks(primaries, edges, edges.limit(0), kinds, parts=nodes.select("node", F.col("method").alias("part")))
    return found.withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), "/"))


@query(f"""
WITH RECURSIVE {EVENT_GRAPH}, w(node, round) AS (SELECT event_id, 0 FROM events WHERE event_type = 'error' UNION SELECT g.src, round + 1 FROM w JOIN g ON g.dst = w.node WHERE round < 4)
SELECT node, min(round) AS round FROM w GROUP BY node
""")
def wrapper_fixpoint(spark, sf_dir):
    """Events that come to an error within four calls."""
    nodes, edges = event_graph(spark, sf_dir)
    return graph.fixpoint(nodes.where("event_type = 'error'").select("node"), edges, 4)


@query(f"""
WITH {EVENT_GRAPH}, o AS (SELECT src AS node, count(*) AS n FROM g GROUP BY 1), i AS (SELECT dst AS node, count(*) AS n FROM g GROUP BY 1),
d AS (SELECT e.user_id AS method, e.event_id AS node, coalesce(o.n, 0) AS n_out, coalesce(i.n, 0) AS n_in FROM e LEFT JOIN o ON o.node = event_id LEFT JOIN i ON i.node = event_id)
SELECT d.method, count(*) AS n_nodes, count(*) FILTER (WHERE n_in = 0) AS n_entries, count(*) FILTER (WHERE n_out = 0) AS n_exits, count(*) FILTER (WHERE n_out > 1) AS n_branches, count(*) FILTER (WHERE n_in > 1) AS n_joins,
  (SELECT count(*) FROM g WHERE g.method = d.method) AS n_edges, false AS has_loop FROM d GROUP BY d.method
""")
def cfg_degrees(spark, sf_dir):
    """Users as methods."""
    nodes, edges = event_graph(spark, sf_dir)
    return cfg.report(nodes, edges)


@query(f"""
WITH RECURSIVE {EVENT_GRAPH}, o AS (SELECT src, count(*) AS n FROM g GROUP BY 1), i AS (SELECT dst, count(*) AS n, min(src) AS src FROM g GROUP BY 1),
p AS (SELECT i.dst AS node, i.src AS pred FROM i JOIN o ON o.src = i.src WHERE i.n = 1 AND o.n = 1),
b(node, leader) AS (SELECT event_id, event_id FROM events WHERE event_id NOT IN (SELECT node FROM p) UNION ALL SELECT p.node, b.leader FROM b JOIN p ON p.pred = b.node)
SELECT user_id AS method, leader, count(*) AS n_nodes, min(node) AS first_line, max(node) AS last_line FROM b JOIN events ON event_id = leader GROUP BY 1, 2
""")
def basic_blocks(spark, sf_dir):
    nodes, edges = event_graph(spark, sf_dir)
    return cfg.block_summary(cfg.basic_blocks(nodes.drop("event_type"), edges)).select("method", "leader", "n_nodes", "first_line", "last_line")


@query(f"""
WITH RECURSIVE {EVENT_GRAPH}, x AS (SELECT method, src, list(dst ORDER BY dst) AS nxt FROM g GROUP BY 1, 2),
p(method, path, ended) AS (SELECT user_id, [event_id], false FROM events WHERE event_id NOT IN (SELECT dst FROM g)
  UNION ALL SELECT p.method, CASE WHEN t IS NULL THEN path ELSE list_append(path, t) END, t IS NULL OR len(path) + 1 >= 20
  FROM p LEFT JOIN x ON x.method = p.method AND x.src = path[-1], unnest(CASE WHEN nxt IS NULL THEN [NULL] ELSE nxt END) AS u(t) WHERE NOT ended)
SELECT method, n, array_to_string(path, '/') AS path FROM (SELECT method, path, row_number() OVER (PARTITION BY method ORDER BY path) AS n FROM p WHERE ended) WHERE n <= 8
""")
def block_paths(spark, sf_dir):
    """The first eight runs of each user from the first event on, at most twenty events long."""
    nodes, edges = event_graph(spark, sf_dir)
    entries = cfg.degrees(nodes, edges).where("is_entry").select("method", "node")
    return cfg.block_paths(edges, entries).drop("conditions")


# ---------------------------------------------------------------- packing


@query("""
WITH RECURSIVE d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents WHERE n_chars > 0),
w(source, doc_id, n_chars, i, chunk, used) AS (SELECT source, doc_id, n_chars, i, 1, n_chars FROM d WHERE i = 1
  UNION ALL SELECT d.source, d.doc_id, d.n_chars, d.i, CASE WHEN used >= 20000 OR used + d.n_chars > 25000 THEN chunk + 1 ELSE chunk END, CASE WHEN used >= 20000 OR used + d.n_chars > 25000 THEN d.n_chars ELSE used + d.n_chars END
  FROM w JOIN d ON d.source = w.source AND d.i = w.i + 1)
SELECT source, doc_id, n_chars, chunk, n_chars > 25000 AS oversized FROM w
""")
def pack_files(spark, sf_dir):
    """Documents of a source as its files."""
    return pack.pack_ordered(read(spark, sf_dir, "documents"), "source", "doc_id", "n_chars", 20_000, 25_000)


@query("""
WITH RECURSIVE l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, i, CAST(length(ls[i]) AS BIGINT) + CASE WHEN i < len(ls) THEN 1 ELSE 0 END AS n FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l)),
p AS (SELECT doc_id, i, k, least(5000, n - 5000 * k) AS n FROM (SELECT doc_id, i, n, unnest(range(0, (n + 4999) // 5000)) AS k FROM e WHERE n > 0)),
u AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) AS i, n FROM p),
f AS (SELECT doc_id, i, n, n AS used, CAST(1 AS BIGINT) AS chunk FROM u WHERE i = 1
  UNION ALL SELECT u.doc_id, u.i, u.n, CASE WHEN f.used >= 4000 OR f.used + u.n > 5000 THEN u.n ELSE f.used + u.n END, f.chunk + CASE WHEN f.used >= 4000 OR f.used + u.n > 5000 THEN 1 ELSE 0 END FROM f JOIN u ON u.doc_id = f.doc_id AND u.i = f.i + 1),
c AS (SELECT doc_id, chunk, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY doc_id, chunk)
SELECT doc_id, chunk, CAST(sum(n) OVER w - n AS BIGINT) AS start, CAST(sum(n) OVER w AS BIGINT) AS stop, CAST(n AS INTEGER) AS n_chars FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY chunk)
""")
def pack_text(spark, sf_dir):
    """Documents in chunks of 4,000 to 5,000 characters; bodies joined give the text back."""
    found = pack.pack_text(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", 4000, 5000)
    return found.select("doc_id", "chunk", "start", "stop", F.length("body").alias("n_chars"))


@query()
def pack_graph(spark, sf_dir):
    """Parts as methods and the suppliers that deliver them as shared types; brands are pages."""
    part = read(spark, sf_dir, "part")
    page = F.xxhash64("p_brand").alias("page")
    methods = part.select(page, F.col("p_partkey").alias("ord"), F.col("p_partkey").cast("string").alias("method"), (F.length("p_name") * 10).alias("chars"))
    links = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").cast("string").alias("domain")).distinct()
    domains = links.join(part.select("p_partkey", "p_brand"), "p_partkey").select(page, F.col("p_partkey").cast("string").alias("method"), "domain", F.lit(60).alias("chars"))
    return pack.pack_graph(methods, domains, 4000, 5000)


@query("SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 20 AS batch FROM documents")
def batch_fixed(spark, sf_dir):
    return pack.batches(read(spark, sf_dir, "documents").select("source", "doc_id"), "source", ["doc_id"])


@query("""
SELECT conv_id, '[' || string_agg('P' || lpad(CAST(turn + 1 AS VARCHAR), 3, '0') || ':' || role, ', ' ORDER BY turn) || ']' AS text FROM conversations GROUP BY conv_id
""")
def rendered_turns(spark, sf_dir):
    """Turns with temporary ids, rendered in order."""
    line = F.concat_ws(":", text.numbered("P", F.col("turn") + 1), "role")
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(render.joined(line, "turn", ", ").alias("t"))
    return rows.select("conv_id", F.concat(F.lit("["), "t", F.lit("]")).alias("text"))


# ---------------------------------------------------------------- the bundle


@query("""
WITH a AS (SELECT user_id, min(event_id) AS ord, 'user_' || user_id AS rid, min(event_type) AS name FROM events GROUP BY 1),
n AS (SELECT ord, 'R.id.' || rid AS resource_id, name, CAST(user_id AS VARCHAR) AS node FROM a),
anchors AS (SELECT ord, resource_id, name, node, 'anchor_' || substr(sha1(resource_id || '||' || name || '||' || ''), 1, 12) AS uid FROM n)
SELECT e.event_id AS ord, uid AS anchor_uid, CASE WHEN e.event_type = anchors.name THEN 1 ELSE 2 END AS tier,
  CASE e.event_type WHEN 'click' THEN 'write' WHEN 'purchase' THEN 'write' WHEN 'view' THEN 'read' WHEN 'signup' THEN 'sink' ELSE 'unknown' END AS kind
FROM events e JOIN anchors ON anchors.resource_id = 'R.id.user_' || e.user_id
""")
def bundle(spark, sf_dir):
    """Users as anchors (named by their first kind of event in the alphabet), events as usages: resolved, classified evidence."""
    events = read(spark, sf_dir, "events")
    rid = F.concat(F.lit("R.id.user_"), F.col("user_id").cast("string"))
    anchors = events.groupBy("user_id").agg(F.min("event_id").alias("ord"), F.min("event_type").alias("anchor_name"))
    anchors = anchors.select("ord", rid.alias("resource_id"), "anchor_name", F.lit("").alias("location"), F.lit("View").alias("view_type"), F.col("user_id").cast("string").alias("cpg_node_id"))
    kind = F.when(F.col("event_type").isin("click", "purchase"), "SETTER").when(F.col("event_type") == "view", "GETTER").when(F.col("event_type") == "signup", "LISTENER").otherwise("OTHER")
    usages = events.select(
        F.col("event_id").alias("ord"), rid.alias("resource_id"), F.col("event_type").alias("name"), F.lit("").alias("location"), F.array(F.col("user_id").cast("string")).alias("node_ids"),
        F.col("props").alias("code"), kind.alias("usage_kind"), F.concat(F.lit("app.User."), "event_type").alias("method"),
    )
    return evidence.bundle(anchors, usages)["usages"].select("ord", "anchor_uid", "tier", "kind")
