"""Walks over edge tables: closures, paths, fixpoints; bounded, or (max_depth None) until nothing is left.

All are loops over frontiers: a round is one join of the newest rows with the edges and one anti-join with what has
been seen. Each round is written to the shared folder, so plans stay short and a lost executor costs one
round. Ties go to the shortest, then the lexicographically smallest path.
"""

from __future__ import annotations

import contextlib
import contextvars
import itertools
import os
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a temporary one, but only if all tasks run on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "weft-checkpoints"))
    return sc.getCheckpointDir()


def kept_by_parquet(schema: StructType) -> bool:
    names = [f.name.lower() for f in schema]
    return 0 < len(names) == len(set(names)) and not any(kind in schema.simpleString() for kind in ("void", "interval"))


def cut(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder as Parquet and read back: a fraction of a checkpoint's bytes, only the columns that are needed, and small files share tasks.

    What Parquet can't hold (no columns, equal names, void or interval types) is checkpointed.
    """
    folder = shared_folder(df.sparkSession)
    if not kept_by_parquet(df.schema):
        return df.checkpoint(eager=True)
    path = f"{folder}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PLACES[out] = path
    for made in _SCRATCH.get():
        made[path] = df.sparkSession
    return out


_PLACES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_SCRATCH: contextvars.ContextVar[tuple[dict[str, SparkSession], ...]] = contextvars.ContextVar("scratch", default=())


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end what `cut` wrote inside, but for tables that went through the function it gives; nothing that is still to run may read the rest."""
    made: dict[str, SparkSession] = {}
    token = _SCRATCH.set((*_SCRATCH.get(), made))

    def keep(table: DataFrame) -> DataFrame:
        made.pop(_PLACES.get(table), None)
        return table

    try:
        yield keep
    finally:
        _SCRATCH.reset(token)
    for path, spark in made.items():
        deleted(path, spark)


def deleted(path: str, spark: SparkSession) -> None:
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Deletes what `cut` wrote for these, once nothing that is still to run reads it."""
    for t in tables:
        if path := _PLACES.pop(t, None):
            deleted(path, t.sparkSession)


def rounds(max_depth: int | None) -> Iterable[int]:
    return itertools.count(1) if max_depth is None else range(1, max_depth + 1)


def gathered(seen: DataFrame, frontier: DataFrame, depth: int) -> DataFrame:
    """What was seen and the newest rows; written anew after each eighth round, so that a long walk keeps a short plan."""
    seen = seen.unionByName(frontier)
    return cut(seen) if depth % 8 == 0 else seen


def merged_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of the nodes 0 to n - 1 the smallest that each hangs together with over links a, b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def components(links: DataFrame, slice_: int = 1 << 18) -> DataFrame:
    """node, label: what hangs together over links (a, b) has one label, a node of it.

    Links in the order of their nodes are contracted a slice at a time; nodes that lie in several slices link what these made of them, and that
    smaller graph is contracted in turn.
    """

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in sliced(batches, slice_):
            both = pa.chunked_array([*held["a"].chunks, *held["b"].chunks]).combine_chunks().dictionary_encode()
            if isinstance(both, pa.ChunkedArray):
                both = both.combine_chunks()
            codes = both.indices.to_numpy()
            label = merged_labels(codes[: len(held)], codes[len(held) :], len(both.dictionary))
            yield pa.RecordBatch.from_arrays([both.dictionary, both.dictionary.take(pa.array(label))], names=["node", "root"])

    links = links.select("a", "b").where("a is not null and b is not null")
    kind = links.schema["a"].dataType.simpleString()
    there = cut(links.repartitionByRange("a", "b").sortWithinPartitions("a", "b").mapInArrow(contract, f"node {kind}, root {kind}"))
    low = there.groupBy("node").agg(F.min("root").alias("label"), F.max("root").alias("_most"))
    several = there.join(low.where("label <> _most"), "node").where("root <> label")
    rest = cut(several.select(F.col("label").alias("a"), F.col("root").alias("b")).distinct())
    low = low.drop("_most")
    if rest.isEmpty():
        return low
    known = components(rest, slice_).select(F.col("node").alias("label"), F.col("label").alias("_label"))
    return low.join(known, "label", "left").select("node", F.coalesce("_label", "label").alias("label"))


def sliced(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The rows in tables of `most` rows, the last one smaller."""
    held, size = [], 0
    for b in batches:
        while b.num_rows:
            part = b.slice(0, most - size)
            held.append(part)
            size, b = size + part.num_rows, b.slice(part.num_rows)
            if size == most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


def shortest_paths(roots: DataFrame, edges: DataFrame, max_depth: int | None) -> DataFrame:
    """root, node, depth, path (array): all nodes within max_depth of each root (column root), roots at depth 0.

    Of the paths to a node that are equally short, the smallest in array order stays; since a prefix of a smallest
    shortest path is one itself, a round needs the previous frontier only.
    """
    edges = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    seen = cut(roots.select("root").distinct().select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.array("root").alias("path")))
    frontier = seen
    for depth in rounds(max_depth):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select("root", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        step = step.join(seen.select("root", "node"), ["root", "node"], "left_anti")
        frontier = cut(step.groupBy("root", "node").agg(F.min("path").alias("path")).select("root", "node", F.lit(depth).alias("depth"), "path"))
        if frontier.isEmpty():
            break
        seen = gathered(seen, frontier, depth)
    return seen


def forward_closure(roots: DataFrame, edges: DataFrame, nodes: DataFrame, max_depth: int = 5) -> DataFrame:
    """What each root reaches over nodes whose `domain` flag holds, without itself."""
    domain = nodes.where("domain").select(F.col("node").alias("dst"))
    return shortest_paths(roots, edges.join(domain, "dst", "left_semi"), max_depth).where("depth > 0")


CHAINS = ["SELF", "LAMBDA_REGISTRATION_CHAIN", "CALLER_CHAIN"]  # relations, the one that counts first


def backward_callbacks(primaries: DataFrame, calls: DataFrame, hosts: DataFrame, nodes: DataFrame, max_depth: int | None = None, parts: DataFrame | None = None, most: int = 4096) -> DataFrame:
    """root, callback, kind, relation, depth, path: the callbacks that lead to each primary, best path for each.

    calls (src calls dst) and hosts (src registers the lambda dst) are walked backwards over nodes that are not of
    the framework. nodes: node, callback_kind (null: none), framework. Relations: SELF, CALLER_CHAIN over calls,
    LAMBDA_REGISTRATION_CHAIN over hosts; the last one that changed it counts, and a node may be met under several.
    A node is met once for each relation, so cycles end the walk.

    parts: node, part, a split that edges rarely cross, if one is known. A part of at most `most` edges that none crosses is walked
    in a task, root by root; all others, and nodes without a part, by rounds over the tables.
    """
    edges = calls.select("src", "dst", F.lit(False).alias("via_host")).unionByName(hosts.select("src", "dst", F.lit(True).alias("via_host"))).distinct()
    own = nodes.where("not framework").select(F.col("node").alias("src"))
    edges, start = edges.join(own, "src", "left_semi"), primaries.select("root").distinct()
    kinds = nodes.where("callback_kind is not null").select("node", F.col("callback_kind").alias("kind"))
    if parts is None:
        return backward_rounds(start, cut(edges), kinds, max_depth)
    side = lambda name: parts.select(F.col("node").alias(name), F.col("part").alias(f"_{name}"))
    edges = cut(edges.join(side("src"), "src", "left").join(side("dst"), "dst", "left"))
    roots = start.join(side("root"), "root", "left")
    crossing = edges.where("not (_src <=> _dst)")
    wide = edges.groupBy(F.col("_src").alias("part")).count().where(F.col("count") > most).select("part")
    wide = cut(wide.unionByName(crossing.select(F.col("_src").alias("part"))).unionByName(crossing.select(F.col("_dst").alias("part"))).where("part is not null").distinct())
    open_ = lambda rows, by: rows.join(wide.withColumnRenamed("part", by), by, "left_semi").unionByName(rows.where(F.col(by).isNull()))
    shut = lambda rows, by: rows.where(F.col(by).isNotNull()).join(wide.withColumnRenamed("part", by), by, "left_anti")
    own_kinds = shut(kinds.join(side("node"), "node"), "_node")
    row = lambda what, part, node, src, via, kind: F.struct(F.col(part).alias("part"), F.lit(what).alias("what"), F.col(node).alias("node"), src.alias("src"), via.alias("via_host"), kind.alias("kind"))
    no, node_type = F.lit(None), start.schema["root"].dataType
    rows = shut(edges, "_src").select(row("edge", "_src", "dst", F.col("src").cast(node_type), F.col("via_host"), no.cast("string")).alias("r"))
    rows = rows.unionAll(shut(roots, "_root").select(row("root", "_root", "root", no.cast(node_type), no.cast("boolean"), no.cast("string"))))
    rows = rows.unionAll(own_kinds.select(row("kind", "_node", "node", no.cast(node_type), no.cast("boolean"), F.col("kind"))))
    schema = f"root {(t := node_type.simpleString())}, callback {t}, kind string, relation string, depth int, path array<{t}>"
    rows = rows.select("r.*").repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part").sortWithinPartitions("part")
    found = rows.mapInArrow(partial(backward_parts, schema=to_arrow_schema(start.sparkSession.createDataFrame([], schema).schema), max_depth=max_depth), schema)
    left = cut(open_(roots, "_root").select("root"))
    if left.isEmpty():
        return found
    rest = cut(open_(edges, "_src").select("src", "dst", "via_host"))
    return found.unionByName(backward_rounds(left, rest, kinds, max_depth))


def backward_parts(batches: Iterator[pa.RecordBatch], schema: pa.Schema, max_depth: int | None) -> Iterator[pa.RecordBatch]:
    """The callbacks of each root, from rows (part, what, node, src, via_host, kind) in order of parts; edges are those of one part at a time."""
    rows, out = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), []
    for _, part in itertools.groupby(rows, lambda r: r[0]):
        into, kinds, roots = {}, {}, []
        for _, what, node, src, via_host, kind in part:
            if what == "edge":
                into.setdefault(node, []).append((src, via_host))
            elif what == "kind":
                kinds[node] = min(kind, kinds.get(node, kind))
            else:
                roots.append(node)
        for root in roots:
            out += [(root, node, kinds[node], CHAINS[rank], depth, list(path)) for node, (depth, rank, path) in backward_walk(root, into, kinds, max_depth).items()]
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def backward_walk(root, into: dict, kinds: dict, max_depth: int | None) -> dict:
    """node: (depth, rank, path), the best way from each node with a kind to the root."""
    frontier, best, depth = {(root, 0): (root,)}, {}, 0
    seen = set(frontier)
    while frontier:
        for (node, rank), path in frontier.items():
            if node in kinds and (node not in best or (depth, rank, path) < best[node]):
                best[node] = (depth, rank, path)
        if depth == max_depth:
            break
        depth, step = depth + 1, {}
        for (node, rank), path in frontier.items():
            for src, via_host in into.get(node, ()):
                key = (src, 1 if via_host else rank or 2)
                if key not in seen and (key not in step or path < step[key]):
                    step[key] = path
        frontier = {key: (key[0], *path) for key, path in step.items()}
        seen.update(frontier)
    return best


def backward_rounds(start: DataFrame, edges: DataFrame, kinds: DataFrame, max_depth: int | None) -> DataFrame:
    """The rows of backward_callbacks, by rounds. start: root; edges: src, dst, via_host; kinds: node, kind."""
    seen = cut(start.select("root", F.col("root").alias("node"), F.lit("SELF").alias("relation"), F.lit(0).alias("depth"), F.array("root").alias("path")))
    frontier = seen
    for depth in rounds(max_depth):
        step = frontier.join(edges, frontier["node"] == edges["dst"])
        relation = F.when(F.col("via_host"), "LAMBDA_REGISTRATION_CHAIN").when(F.col("relation") == "SELF", "CALLER_CHAIN").otherwise(F.col("relation"))
        step = step.select("root", F.col("src").alias("node"), relation.alias("relation"), F.concat(F.array("src"), "path").alias("path"))
        step = step.join(seen.select("root", "node", "relation"), ["root", "node", "relation"], "left_anti")
        frontier = cut(step.groupBy("root", "node", "relation").agg(F.min("path").alias("path")).select("root", "node", "relation", F.lit(depth).alias("depth"), "path"))
        if frontier.isEmpty():
            break
        seen = gathered(seen, frontier, depth)
    rank = F.when(F.col("relation") == "SELF", 0).when(F.col("relation") == "LAMBDA_REGISTRATION_CHAIN", 1).when(F.col("relation") == "CALLER_CHAIN", 2).otherwise(9)
    found = seen.join(kinds, "node")
    best = found.groupBy("root", F.col("node").alias("callback")).agg(F.min(F.struct("depth", rank.alias("rank"), "path", "relation", "kind")).alias("b"))
    return best.select("root", "callback", "b.kind", "b.relation", "b.depth", "b.path")


def fixpoint(seed: DataFrame, edges: DataFrame, max_rounds: int) -> DataFrame:
    """node, round: nodes that reach the seed over edges (src needs dst), by the round in which they are found."""
    edges = cut(edges.select("src", "dst").distinct())
    seen = cut(seed.select("node").distinct().withColumn("round", F.lit(0)))
    frontier = seen
    for n in range(1, max_rounds + 1):
        step = frontier.join(edges, frontier["node"] == edges["dst"]).select(F.col("src").alias("node")).distinct()
        frontier = cut(step.join(seen, "node", "left_anti").withColumn("round", F.lit(n)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def first_value(starts: DataFrame, edges: DataFrame, values: DataFrame, max_depth: int = 4) -> DataFrame:
    """root, value, depth: the value of the nearest node that has one (smallest path among equals): aliases to what they stand for."""
    found = shortest_paths(starts, edges, max_depth).join(values, "node")
    return found.groupBy("root").agg(F.min(F.struct("depth", "path", "value")).alias("b")).select("root", "b.value", "b.depth")


def ancestors(parents: DataFrame, max_depth: int | None = None) -> DataFrame:
    """node, ancestor, distance over a tree of (node, parent), by doubling: log2(depth) joins; parents in a cycle are an error unless max_depth is set."""
    up = cut(parents.where("parent is not null").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")))
    reach = 1
    while max_depth is None or reach < max_depth:
        more = up.alias("x").join(up.alias("y"), F.col("x.ancestor") == F.col("y.node")).where(F.col("x.distance") == reach)
        more = more.select("x.node", "y.ancestor", (F.col("x.distance") + F.col("y.distance")).alias("distance"))
        up = cut(up.unionByName(more if max_depth is None else more.where(F.col("distance") <= max_depth)))
        longer = up.where(F.col("distance") > reach)
        if longer.isEmpty():
            break
        if max_depth is None and not longer.where("node = ancestor").isEmpty():
            raise ValueError("parents form a cycle")
        reach *= 2
    return up


def nearest_ancestor(closure: DataFrame, nodes: DataFrame, matches: Column) -> DataFrame:
    """node, ancestor: the nearest ancestor that fulfils the condition on the nodes' columns."""
    ok = nodes.where(matches).select(F.col("node").alias("ancestor"))
    return closure.join(ok, "ancestor", "left_semi").groupBy("node").agg(F.min_by("ancestor", F.struct("distance", "ancestor")).alias("ancestor"))


def expand_references(declarations: DataFrame, strategies: dict[str, DataFrame]) -> DataFrame:
    """declaration, reference, strategy: union of the strategies' (declaration, reference) rows; the first named strategy that has one counts."""
    out = None
    for i, (name, rows) in enumerate(strategies.items()):
        one = rows.join(declarations.select("declaration"), "declaration", "left_semi").select("declaration", "reference", F.struct(F.lit(i).alias("i"), F.lit(name).alias("name")).alias("s"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("declaration", "reference").agg(F.min("s").alias("s")).select("declaration", "reference", F.col("s.name").alias("strategy"))


def argument_hop(anchors: DataFrame, arguments: DataFrame, parameters: DataFrame, references: DataFrame) -> DataFrame:
    """anchor, reference: an anchor passed as an argument, followed to the uses of the callee's parameter."""
    passed = anchors.join(arguments, "node").join(parameters, ["callee", "position"])
    return passed.join(references.select(F.col("declaration").alias("parameter"), "reference"), "parameter").select("anchor", "reference").distinct()
