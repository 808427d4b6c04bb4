"""Slices, usages and methods put together: bundle, payload, evidence index, attribution, inverse indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.classify import evidence_kind
from weft.functions.text import contains_token, first_non_blank, missing_body_reason, non_blank, normalized, stable_uid

from .ranked import top1
from .resolve import resolve_anchors

# Resource ids that stand for what analysis could not tell.
DYNAMIC = ["UNKNOWN_DYNAMIC_RESOURCE"]


def ordered(value: Column | str, order: Column | str, distinct: bool = True) -> Column:
    """Aggregate: the values in order, each once where it comes first."""
    value, order = (F.col(x) if isinstance(x, str) else x for x in (value, order))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"])
    return F.filter(F.array_distinct(listed), lambda x: x.isNotNull()) if distinct else listed


def anchor_rows(raw: DataFrame) -> DataFrame:
    """Anchors with uid, name, location, node_ids; dynamic resources left out.

    raw: ord, resource_id, view_type, and of the optional columns those that it has.
    """
    has = lambda *names: [F.col(n) for n in names if n in raw.columns] or [F.lit(None).cast("string")]
    name = first_non_blank(*has("anchor_name", "handle_name", "binding_field"))
    location = first_non_blank(*has("location", "anchor_location", "occurrence_location"))
    ids = F.array(*[normalized(c) for c in has("cpg_node_id", "handle_owner_node_id", "occurrence_node_id")])
    rows = raw.where(~F.col("resource_id").isin(DYNAMIC)).withColumns({"name": F.coalesce(name, F.lit("")), "location": F.coalesce(location, F.lit("")), "node_ids": F.filter(ids, lambda x: x != "")})
    rows = rows.withColumn("uid", stable_uid("anchor", "resource_id", "name", "location"))
    return top1(rows, ["uid"], [F.col("ord")]).select("ord", "uid", "resource_id", "name", "location", "view_type", "node_ids")


def bundle(anchors: DataFrame, usages: DataFrame) -> dict[str, DataFrame]:
    """anchors, usages, evidence, warnings.

    usages: ord, resource_id, name, location, node_ids, code, usage_kind, method. Usages outside any method go; those
    of an ambiguous resource leave a warning.
    """
    kept = anchor_rows(anchors)
    lost = anchors.where(F.col("resource_id").isin(DYNAMIC)).select(F.lit("dynamic_resource_id").alias("code"), F.col("resource_id").alias("subject"))
    found = resolve_anchors(usages.where(non_blank("method").isNotNull()), kept.select("uid", "resource_id", "name", "location", "node_ids", "ord"))
    found = found.withColumn("usage_uid", stable_uid("usage", "anchor_uid", "method", "location", "code", "usage_kind")).withColumn("kind", evidence_kind("usage_kind"))
    evidence = top1(found, ["usage_uid"], [F.col("ord")]).select(stable_uid("evidence", "usage_uid", "kind").alias("evidence_uid"), "usage_uid", "anchor_uid", "kind", "method", "code")
    doubtful = found.where("ambiguous").select(F.lit("ambiguous_anchor").alias("code"), F.col("resource_id").alias("subject"))
    return {"anchors": kept, "usages": found, "evidence": evidence, "warnings": lost.unionByName(doubtful).distinct()}


def call_paths(slices: DataFrame, direction: str) -> DataFrame:
    """Distinct paths of each slice, the first of equal ones; forward paths start at the slice's primary method."""
    rows = slices.select("slice", "primary_method", F.posexplode("call_paths").alias("ord", "p")).where(F.upper(F.col("p.direction")) == direction)
    if direction == "FORWARD":
        rows = rows.where(F.get("p.path_methods", F.lit(0)) == F.col("primary_method"))
    return top1(rows.select("slice", "primary_method", "ord", "p.*"), ["slice", "path_methods"], [F.col("ord")])


def handlers(slices: DataFrame) -> DataFrame:
    """Distinct (root, kind, resource) of backward paths; resource is blank where a slice has none."""
    paths = call_paths(slices, "BACKWARD").where(non_blank("root_callback").isNotNull()).select("slice", "root_callback", "callback_kind")
    ids = slices.select("slice", F.explode_outer("resource_ids").alias("resource_id"))
    return paths.join(ids, "slice").select(F.col("root_callback").alias("root"), F.col("callback_kind").alias("kind"), F.coalesce("resource_id", F.lit("")).alias("resource_id")).distinct()


def method_slices(slices: DataFrame, bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Slices with the source of their primary method or the reason why none; and warnings for what is missing."""
    body = bodies.groupBy(F.col("method_full_name").alias("primary_method")).agg(F.max_by("body", "ord").alias("body"))
    out = slices.join(body, "primary_method", "left").withColumn("source_code", non_blank("body")).drop("body")
    out = out.withColumn("nullable_reason", F.when(F.col("source_code").isNull(), missing_body_reason("primary_method")))
    return out, out.where("source_code is null").select(F.lit("missing_method_source").alias("code"), F.col("primary_method").alias("subject")).distinct()


def payload(slices: DataFrame, visible: DataFrame, bodies: DataFrame, types: DataFrame) -> dict[str, DataFrame]:
    """What the visible resources (resource_id) bring into view: slices, resource index, methods, types, stats."""
    used = slices.where("not incomplete").select("slice", "primary_method", F.explode("resource_ids").alias("resource_id"), "method_body_refs", "domain_type_refs")
    used = used.join(visible.select("resource_id").distinct(), "resource_id", "left_semi")
    primary = used.groupBy(F.col("primary_method").alias("method")).agg(F.sort_array(F.collect_set("resource_id")).alias("resource_ids"), F.min("slice").alias("ord"))
    refs = used.select(F.explode("method_body_refs").alias("method"), "resource_id").groupBy("method").agg(F.sort_array(F.collect_set("resource_id")).alias("resource_ids"))
    refs = refs.join(primary.select("method"), "method", "left_anti")
    source = bodies.groupBy(F.col("method_full_name").alias("method")).agg(F.max_by("body", "ord").alias("source_code"))
    methods = primary.select("method", F.lit("primary").alias("role"), "resource_ids").unionByName(refs.select("method", F.lit("body_ref").alias("role"), "resource_ids")).join(source, "method", "left")
    names = used.select(F.explode("domain_type_refs").alias("type_full_name")).distinct()
    known = types.groupBy("type_full_name").agg(F.max_by(F.struct("kind", "body"), "ord").alias("t"))
    listed = names.join(known, "type_full_name").select("type_full_name", "t.*", F.size(F.split("t.body", "\n")).alias("body_lines"))
    stats = used.agg(F.countDistinct("slice").alias("n_slices"), F.countDistinct("resource_id").alias("n_resources"), F.countDistinct("primary_method").alias("n_primary"))
    index = used.groupBy("resource_id").agg(F.sort_array(F.collect_set("slice")).alias("slices"))
    return {"slices": used, "index": index, "methods": methods, "types": listed, "missing": names.join(known, "type_full_name", "left_anti"), "stats": stats}


def gathered(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, values (distinct, in order), n rows and the first ord; repetitions are summed up before the values of a key meet."""
    pairs = rows.where(F.col(key).isNotNull()).groupBy(key, value).agg(F.min("ord").alias("ord"), F.count("*").alias("n"))
    return pairs.groupBy(key).agg(ordered(value, "ord").alias(value + "s"), F.sum("n").alias("n"), F.min("ord").alias("ord"))


def evidence_index(occurrences: DataFrame) -> dict[str, DataFrame]:
    """Vertices, edges and savings of a typed graph.

    occurrences: ord, resource, method, type (null: none). Vertices keep where they come from; an edge is there once.
    `avoided` is how many repetitions of methods and types sending each once saves.
    """
    methods, types = gathered(occurrences, "method", "resource"), gathered(occurrences, "type", "method")
    edge = lambda a, b: occurrences.where(f"{a} is not null and {b} is not null").select(a, b).distinct()
    save = lambda key: occurrences.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).agg(F.lit(key).alias("kind"), F.count("*").alias("n_unique"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_occurrences"))
    stats = save("method").unionByName(save("type"))
    stats = stats.withColumn("avoided", F.greatest(F.col("n_occurrences") - F.col("n_unique"), F.lit(0)))
    return {"methods": methods, "types": types, "resource_method": edge("resource", "method"), "method_type": edge("method", "type"), "resource_type": edge("resource", "type"), "stats": stats}


def attributed(methods: DataFrame, types: DataFrame, slice_refs: DataFrame, policy: str) -> DataFrame:
    """method, type, attached for the types that a method's slice refers to.

    slice_local attaches all of them; method_local those that declare the method or are named in its source.
    methods: method, source_code. slice_refs: method, type.
    """
    rows = slice_refs.select("method", "type").distinct().join(types.select("type"), "type", "left_semi")
    if policy == "slice_local":
        return rows.withColumn("attached", F.lit(True))
    rows = rows.join(methods.select("method", "source_code"), "method")
    short = F.element_at(F.split("type", r"[.$]"), -1)
    text = normalized("source_code")
    named = text.contains(F.col("type")) | ((F.length(short) >= 3) & contains_token(text, short))
    return rows.select("method", "type", (F.col("method").startswith(F.concat("type", F.lit("."))) | named).alias("attached"))


def inverse_index(rows: DataFrame, key: str, values: str, value: str, order: str) -> DataFrame:
    """Of every element of an array column, the rows that hold it, in order."""
    return gathered(rows.select(F.explode(values).alias(key), value, F.col(order).alias("ord")), key, value).select(key, value + "s")


def direct_callees(paths: DataFrame, method: str, path: str) -> DataFrame:
    rows = paths.where((F.get(path, F.lit(0)) == F.col(method)) & (F.size(path) > 1)).select(method, F.get(path, F.lit(1)).alias("callee"))
    return rows.distinct()


def path_overview(paths: DataFrame, root: str, path: str, order: str) -> DataFrame:
    """Distinct paths of each root with their first place and number."""
    return paths.groupBy(root, path).agg(F.min(order).alias("first"), F.count("*").alias("n"))


def duplicated(chunks: DataFrame, key: str, chunk: str, chars: str) -> DataFrame:
    """Keys in more than one chunk, and the characters that repeating them costs."""
    out = chunks.groupBy(key).agg(F.countDistinct(chunk).alias("n_chunks"), F.max(chars).alias("chars")).where("n_chunks > 1")
    return out.withColumn("duplicated_chars", F.col("chars") * (F.col("n_chunks") - 1))


def chunk_edges(edges: DataFrame, chunk: DataFrame, src: str, dst: str, need_both: bool) -> DataFrame:
    """Edges with an end (both ends) in the chunk's nodes."""
    a = edges.join(chunk.select(F.col("node").alias(src)).distinct(), src, "left_semi")
    nodes = chunk.select(F.col("node").alias(dst)).distinct()
    return a.join(nodes, dst, "left_semi") if need_both else a.unionByName(edges.join(nodes, dst, "left_semi")).distinct()


def inventory_summary(decls: DataFrame, name: str, kind: str) -> DataFrame:
    """Total, distinct names and kinds, and how many names are declared more than once."""
    by_name = decls.groupBy(name).agg(F.count("*").alias("n"))
    dup = by_name.agg(F.count_if(F.col("n") > 1).alias("n_duplicate_names"), F.max("n").alias("max_declared"))
    total = decls.agg(F.count("*").alias("n_total"), F.countDistinct(name).alias("n_names"), F.countDistinct(kind).alias("n_kinds"))
    return total.withColumn("_k", F.lit(1)).join(dup.withColumn("_k", F.lit(1)), "_k").drop("_k")


def balanced_extent(lines: DataFrame, key: str, order: str, opens: Column, closes: Column) -> DataFrame:
    """key, last, depth: the first line at which all that was opened is closed again (null if never)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    run = lines.withColumns({"_depth": F.sum(opens - closes).over(w), "_opened": F.sum(opens).over(w)})
    return run.groupBy(key).agg(F.min(F.when((F.col("_opened") > 0) & (F.col("_depth") <= 0), F.col(order))).alias("last"), F.max("_depth").alias("max_depth"), F.max(order).alias("n_lines"))
