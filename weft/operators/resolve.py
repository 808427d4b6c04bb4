"""Joins that take the first tier of conditions under which anything matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.text import non_blank


def lowest_tier(matches: DataFrame, keys: list[str], tier: str = "tier") -> DataFrame:
    """Of each key's matches, those of its lowest tier."""
    low = F.min(tier).over(Window.partitionBy(*keys))
    return matches.withColumn("_low", low).where(F.col(tier) == F.col("_low")).drop("_low")


def tiered(left: DataFrame, tiers: list[tuple[DataFrame, list[str]]], value: str, out: str) -> DataFrame:
    """left with `out` and `tier`: the value of the first lookup that has the row's keys; lookups have unique keys."""
    found = left
    for i, (lookup, keys) in enumerate(tiers):
        found = found.join(lookup.select(*keys, F.col(value).alias(f"_v{i}")), keys, "left")
    values = [F.col(f"_v{i}") for i in range(len(tiers))]
    tier: Column = F.lit(None).cast("int")
    for i in reversed(range(len(tiers))):
        tier = F.when(values[i].isNotNull(), i + 1).otherwise(tier)
    return found.withColumn(out, F.coalesce(*values)).withColumn("tier", tier).drop(*[f"_v{i}" for i in range(len(tiers))])


def unique_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value for keys that have one row only."""
    return df.groupBy(*keys).agg(F.min(value).alias(value), F.count("*").alias("_n")).where("_n = 1").drop("_n")


def resolve_anchors(usages: DataFrame, anchors: DataFrame) -> DataFrame:
    """usages with anchor_uid, tier and ambiguous.

    Tiers: resource, name and place agree (the last anchor of these counts); one of the usage's node ids belongs to
    a single anchor, ids tried in order; the resource's first anchor, ambiguous if it has several.
    anchors: uid, resource_id, name, location, node_ids (array), ord. usages: ord, resource_id, name, location, node_ids.
    """
    exact = anchors.groupBy("resource_id", "name", "location").agg(F.max_by("uid", "ord").alias("_exact"))
    ids = anchors.select("uid", "resource_id", F.explode(F.array_distinct(F.filter("node_ids", lambda x: non_blank(x).isNotNull()))).alias("node_id"))
    nodes = unique_by(ids.distinct(), ["resource_id", "node_id"], "uid")
    firsts = anchors.groupBy("resource_id").agg(F.min_by("uid", "ord").alias("_first"), (F.count("*") > 1).alias("_several"))
    tried = usages.select("ord", "resource_id", F.posexplode("node_ids").alias("_at", "node_id")).join(nodes, ["resource_id", "node_id"])
    by_node = tried.groupBy("ord").agg(F.min_by("uid", "_at").alias("_node"))
    out = usages.join(exact, ["resource_id", "name", "location"], "left").join(by_node, "ord", "left").join(firsts, "resource_id", "left")
    tier = F.when(F.col("_exact").isNotNull(), 1).when(F.col("_node").isNotNull(), 2).when(F.col("_first").isNotNull(), 3)
    out = out.withColumn("anchor_uid", F.coalesce("_exact", "_node", "_first")).withColumn("tier", tier)
    return out.withColumn("ambiguous", (F.col("tier") == 3) & F.coalesce("_several", F.lit(False))).drop("_exact", "_node", "_first", "_several")


def resource_matches(refs: DataFrame, decls: DataFrame, fallback: bool = False) -> DataFrame:
    """refs (ref, owner, name) with the declarations they mean: by full id, else by owner and name, else (without owner) by name.

    With fallback, a reference that nothing declares keeps a row whose declaration is null.
    """
    cols = [c for c in decls.columns if c not in ("owner", "name")]
    by_ref = refs.join(decls.select(*cols, F.col("resource_id").alias("ref")), "ref").withColumn("tier", F.lit(1))
    by_owner = refs.join(decls.select(*cols, "owner", "name"), ["owner", "name"]).withColumn("tier", F.lit(2))
    by_name = refs.where(non_blank("owner").isNull()).join(decls.select(*cols, "name"), "name").withColumn("tier", F.lit(3))
    found = lowest_tier(by_ref.unionByName(by_owner).unionByName(by_name), ["ref", "owner", "name"])
    if fallback:
        met = found.select(*[F.col(k).alias(f"_{k}") for k in ("ref", "owner", "name")]).distinct()
        same = [refs[k].eqNullSafe(met[f"_{k}"]) for k in ("ref", "owner", "name")]
        rest = refs.join(met, same, "left_anti")
        found = found.unionByName(rest.withColumn("tier", F.lit(4)), allowMissingColumns=True)
    return found


def prefixes(texts: DataFrame, text: str, candidates: DataFrame, candidate: str) -> DataFrame:
    """text, candidate: pairs where the candidate is a proper prefix. Texts send all their prefixes to an equi-join."""
    found = candidates.select(F.col(candidate).alias("_p")).where("length(_p) > 0").distinct()
    cut = texts.select(text).distinct().where(F.length(text) > 1)
    cut = cut.select(text, F.explode(F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda n: F.substr(text, F.lit(1), n))).alias("_p"))
    return cut.join(found, "_p").select(text, F.col("_p").alias(candidate))


def method_sources(refs: DataFrame, methods: DataFrame, types: DataFrame) -> DataFrame:
    """Source of each referenced method: its own, its lambda's host's, its constructor's type's, else the reason why none."""
    from weft.functions.text import constructor_owner, lambda_host, method_prefix, missing_body_reason

    own = methods.groupBy("method_full_name").agg(F.max_by("body", "ord").alias("_own"))
    hosts = methods.groupBy(method_prefix("method_full_name").alias("_host")).agg(F.min_by("body", "ord").alias("_host_body"))
    owners = types.groupBy(F.col("type_full_name").alias("_owner")).agg(F.max_by("body", "ord").alias("_type_body"))
    out = refs.withColumn("_host", lambda_host("method_full_name")).withColumn("_owner", constructor_owner("method_full_name"))
    out = out.join(own, "method_full_name", "left").join(hosts, "_host", "left").join(owners, "_owner", "left")
    body = F.coalesce(non_blank("_own"), non_blank("_host_body"), non_blank("_type_body"))
    out = out.withColumn("source", body).withColumn("reason", F.when(body.isNull(), missing_body_reason("method_full_name")))
    return out.drop("_host", "_owner", "_own", "_host_body", "_type_body")
