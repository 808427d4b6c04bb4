"""Approximate nearest neighbours on shifted Hilbert curves (operator 7).

Each of `curves` orderings projects the vectors on a few random orthogonal directions, shifts them at random
inside the curve's cube and sorts them by Hilbert key. Rows of all orderings are range-partitioned and
sorted by (ordering, key) in Spark; a row's place in its ordering is its place in its partition plus the sizes of
the partitions before.

A query looks in at `probes` keys of each ordering: its own, and those of its mirror images across the middle planes that it
is nearest to (single planes and sets of them, least total distance first), since that is where a curve parts neighbours.
Around each key the `window` rows on either side are candidates, around its own key `around` rows, since a dense cluster lies on one
side of all planes; keys have three times 60 bits, so they tell near copies apart. The number of directions follows the logarithm
of the number of rows n, so that a cell of the curve's first level holds about `per_cell` rows at any size, and the number of
probes is `probes` * (n / 50,000) ** 0.6: the share of the table that a query looks at falls as the table grows. Measured through Spark on
near-isotropic 64-dimensional unit vectors, the hardest case: recall@10 over 100 queries of 0.928 at 50,000 and 0.927 at 500,000 rows.

Places are cut into cells. A query's probes go to the cells that their windows touch, where its distance to each candidate is
computed from the original vectors in double precision, `crowd` queries of a cell in a group; each group sends on the query's k + 1 best, which is all of
them that can count, and these merge per query. Nothing is cut off by an approximate distance.

Equal vectors are one class with its smallest ids, so a vector that a third of all rows share is one row in
every ordering, and ties go to the smallest ids exactly.

Defined cases: vectors that are null, empty, zero, of another length than most, or that hold null or non-finite
components take no part, neither do rows without an id; a row that repeats an id is a row of its own, as candidate
and as query (each query row gets its own answer); with fewer than k other rows all are returned; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from ._common import stored


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with integer coordinates below 2^bits (rows: points).

    Gray-coded coordinates are turned level by level, from the coarsest bit down, then interleaved. The place is
    given in columns, each of as many whole levels as 60 bits hold, the coarsest first.
    """
    x = [np.ascontiguousarray(c).astype(np.uint64) for c in cells.T]
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for i in range(dims):
            turned = (x[i] & bit) > 0
            swap = np.where(turned, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, dims):
        x[i] = x[i] ^ x[i - 1]
    mask = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        mask ^= np.where((x[-1] & np.uint64(1 << level)) > 0, np.uint64((1 << level) - 1), np.uint64(0))
    words, filled = [np.zeros_like(mask)], 0
    for level in range(bits - 1, -1, -1):
        if filled + dims > 60:
            words.append(np.zeros_like(mask))
            filled = 0
        for i in range(dims):
            words[-1] = (words[-1] << np.uint64(1)) | (((x[i] ^ mask) >> np.uint64(level)) & np.uint64(1))
        filled += dims
    return np.stack(words, 1)


def vectors(col: pa.Array, size: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def moments(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of all vectors, from sums that each task makes of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size + 1))
        for b in batches:
            v = np.column_stack((np.ones(b.num_rows), vectors(b.column(0), size).astype(np.float64)))
            total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "x"])

    sums = np.zeros((size + 1) ** 2)
    for r in rows.select("vector").mapInArrow(run, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect():
        sums[r["cell"]] = r["x"]
    sums = sums.reshape(size + 1, size + 1)
    n = max(sums[0, 0], 1)
    mean = sums[0, 1:] / n
    return mean, sums[1:, 1:] / n - np.outer(mean, mean)


def orderings(mean: np.ndarray, cov: np.ndarray, curves: int, dims: int, seed: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Directions, offset and scale of each ordering: (v @ directions - offset) * scale lies in the unit cube for nearly all."""
    r = np.random.default_rng(seed)
    out = []
    for _ in range(curves):
        directions = np.linalg.qr(r.normal(size=(len(mean), len(mean))))[0][:, :dims]
        spread = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", directions, cov, directions), 1e-30))
        low = mean @ directions - (4.25 + r.uniform(-0.3, 0.3, directions.shape[1])) * spread
        out.append((directions, low, 1 / (8.5 * spread)))
    return out


def mirrored(unit: np.ndarray, probes: int, points: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, point) for rows of the unit cube: itself first, then its mirror images across the sets of middle planes of least total distance, `probes` in all.

    The sets are built plane by plane, those of least distance kept, which are all that can be part of the answer, so every
    set of planes is in reach of any number of probes. `points` bounds what is made at a time.
    """
    dims = unit.shape[1]
    for at in range(0, len(unit), max(1, points // probes)):
        some = unit[at : at + max(1, points // probes)]
        cost, sets = np.zeros((len(some), 1)), np.zeros((len(some), 1), np.int64)
        away = (some - 0.5) ** 2
        for plane in np.argsort(away.mean(0), kind="stable"):
            cost = np.concatenate((cost, cost + away[:, [plane]]), 1)
            sets = np.concatenate((sets, sets | np.int64(1 << int(plane))), 1)
            if cost.shape[1] > probes:
                keep = np.argpartition(cost[:, 1:], probes - 2, axis=1)[:, : probes - 1] + 1 if probes > 1 else np.zeros((len(some), 0), np.int64)
                keep = np.concatenate((np.zeros((len(some), 1), np.int64), keep), 1)
                cost, sets = np.take_along_axis(cost, keep, 1), np.take_along_axis(sets, keep, 1)
        flip = (sets[:, :, None] >> np.arange(dims)) & 1
        yield np.repeat(np.arange(at, at + len(some)), sets.shape[1]), np.where(flip == 1, 1 - 1e-9 - some[:, None, :], some[:, None, :]).reshape(-1, dims)


def classes(table: DataFrame, k: int, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame, int]:
    """Usable rows (uid, vec_id, vector); distinct vectors: rep (smallest uid), vector, members (vec_id and uid of the k + 1 of smallest id); and their length."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = table.where(F.col(id_col).isNotNull() & v.isNotNull() & sound).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    rows = stored(rows.withColumn("uid", F.monotonically_increasing_id()))
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    size = sizes[0]["size"] if sizes else 1
    rows = rows.where(F.size("vector") == size)
    by = Window.partitionBy("vector").orderBy("vec_id", "uid")
    few = rows.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k + 1)
    out = few.groupBy("vector").agg(F.min("uid").alias("rep"), F.sort_array(F.collect_list(F.struct("vec_id", "uid"))).alias("members"))
    return rows, out.select("rep", F.col("vector").cast("array<double>").alias("vector"), "members"), size


def nearest(
    table: DataFrame, is_query, k: int = 10, curves: int = 24, probes: int = 80, window: int = 4, around: int = 64, per_cell: int = 3, cell: int = 4096, crowd: int = 4096, seed: int = 11,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score for every row whose id fulfils `is_query` (a function of the id column)."""
    rows, found, size = classes(table, k, id_col, vector_col)
    found = stored(found)
    asked = rows.where(is_query(F.col("vec_id"))).select("uid", F.col("vec_id").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
    asked = stored(asked.join(found.select("rep", "vector"), "vector").select("uid", "query_id", "rep"))
    sought = asked.select("rep").distinct().withColumn("q", F.lit(True))
    nodes = found.join(sought, "rep", "left").select("rep", "vector", F.coalesce("q", F.lit(False)).alias("q"))
    n = found.count()
    dims = max(1, min(size, 60, round(math.log2(max(n, 2) / per_cell))))  # 60 bits hold a level of 60 directions, enough for 10 ** 18 rows
    bits = min(20, 3 * (60 // dims))
    probes = max(48, math.ceil(probes * (n / 50_000) ** 0.6))
    plans = orderings(*moments(found, size), curves, dims, seed)
    kind = "<f4" if isinstance(table.schema[vector_col].dataType.elementType, FloatType) else "<f8"  # what holds the vectors exactly

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = vectors(b.column(1), size)
            rep, asks = b.column(0).to_numpy(), np.nonzero(b.column(2).to_numpy(zero_copy_only=False))[0]
            raw = pa.array([x.tobytes() for x in v.astype(kind)], pa.binary())
            for c, (directions, low, scale) in enumerate(plans):
                unit = np.clip((v @ directions - low) * scale, 0, 1 - 1e-9)
                yield sent(c, unit, rep, 0, raw)
                if len(asks):
                    for of, points in mirrored(unit[asks], probes):
                        itself = np.concatenate(([True], of[1:] != of[:-1]))
                        yield sent(c, points, rep[asks[of]], np.where(itself, 2, 1), pa.nulls(len(of), pa.binary()))

    def sent(c: int, unit: np.ndarray, rep: np.ndarray, probe, raw: pa.Array) -> pa.RecordBatch:
        key = hilbert_keys((unit * (1 << bits)).astype(np.int64), bits).astype(np.int64)
        key = np.concatenate((key, np.zeros((len(key), 3 - key.shape[1]), np.int64)), 1)
        cols = [pa.array(np.full(len(key), c, np.int32)), *(pa.array(np.ascontiguousarray(x)) for x in key.T), pa.array(rep), pa.array(np.broadcast_to(probe, len(key)).astype(np.int8)), raw]
        return pa.RecordBatch.from_arrays(cols, names=["curve", "k0", "k1", "k2", "rep", "probe", "vector"])

    keyed = nodes.mapInArrow(keys, "curve int, k0 long, k1 long, k2 long, rep long, probe byte, vector binary")
    parts = max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * curves // 500_000)
    ordered = keyed.repartitionByRange(parts, "curve", "k0", "k1", "k2", "rep").sortWithinPartitions("curve", "k0", "k1", "k2", "rep", "probe")
    numbered = stored(ordered.mapInArrow(counting, "curve int, part int, at long, rep long, probe byte, vector binary"))
    sizes = numbered.where("probe = 0").groupBy("part").agg(F.count("*").alias("n"))
    every = numbered.select("part").distinct().join(sizes, "part", "left")
    firsts = every.select("part", (F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("part")) - F.coalesce("n", F.lit(0))).alias("first"))  # a row for each partition
    placed = numbered.join(firsts, "part").select("curve", (F.col("first") + F.col("at")).alias("place"), "rep", "probe", "vector")
    own = placed.where("probe = 0").select(F.floor(F.col("place") / cell).alias("cell"), "curve", F.array("place").alias("places"), "rep", F.lit(False).alias("probe"), "vector")
    reach = F.sequence(F.floor(F.greatest(F.col("place") - window, F.lit(0)) / cell), F.floor(F.greatest(F.col("place") + window, F.lit(0)) / cell))
    # the wide window around a query's own key is a row of narrow ones
    wide = F.sequence(F.col("place") - around + window, F.col("place") + around - window, F.lit(2 * window).cast("long"))
    asks = placed.where("probe > 0").select("curve", "rep", F.explode(F.when(F.col("probe") == 2, wide).otherwise(F.array("place"))).alias("place"))
    asks = stored(asks.select(F.explode(reach).alias("cell"), "curve", "place", "rep").groupBy("cell", "curve", "rep").agg(F.collect_list("place").alias("places")))
    # a cell that very many queries look into is a group for each so many of them, with the cell's rows in each
    hot = stored(asks.groupBy("cell").agg(F.ceil(F.count("*") / crowd).cast("int").alias("parts")).where("parts > 1"))
    asks = asks.join(hot, "cell", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    own = own.join(hot, "cell", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    whole = nodes.where("q").select("rep", "vector").mapInArrow(raw_vectors(kind, size), "rep long, vector binary")
    asks = asks.join(whole, "rep").select("cell", "part", "curve", "places", "rep", F.lit(True).alias("probe"), "vector")

    def search(table: pa.Table) -> pa.Table:
        probe, curve, rep = (table.column(n).to_numpy() for n in ("probe", "curve", "rep"))
        lists = table.column("places").combine_chunks()
        places, edges = lists.values.to_numpy(), lists.offsets.to_numpy()
        raw = table.column("vector").combine_chunks()
        wide = lambda rows: np.frombuffer(b"".join(raw.take(pa.array(rows)).to_pylist()), kind).reshape(len(rows), -1).astype(np.float64)
        out: list[list[np.ndarray]] = [[], [], []]
        for c in np.unique(curve):
            q, d = np.nonzero(probe & (curve == c))[0], np.nonzero(~probe & (curve == c))[0]
            if not len(q) or not len(d):
                continue
            d = d[np.argsort(places[edges[d]])]
            place, u, v = places[edges[d]], wide(q), wide(d)
            for at in range(0, len(q), 64):  # so many queries at a time, which bounds what is held
                some = q[at : at + 64]
                asked = np.concatenate([places[edges[i] : edges[i + 1]] for i in some])
                who = np.repeat(np.arange(len(some)), edges[some + 1] - edges[some])
                low, high = np.searchsorted(place, asked - window), np.searchsorted(place, asked + window)
                near = np.arange((high - low).sum()) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
                pairs = np.unique(np.repeat(who, high - low) * len(d) + near)
                who, near = pairs // len(d), pairs % len(d)
                gap = np.concatenate([((u[at + who[s : s + 8192]] - v[near[s : s + 8192]]) ** 2).sum(1) for s in range(0, len(who), 8192)] or [np.zeros(0)])
                other = rep[d[near]]
                order = np.lexsort((other, gap, who))
                who, other, gap = who[order], other[order], gap[order]
                best = np.arange(len(who)) - np.searchsorted(who, who) <= k
                for col, x in zip(out, (rep[some][who[best]], other[best], gap[best]), strict=True):
                    col.append(x)
        kinds = (np.int64, np.int64, np.float64)
        return pa.table({n: pa.array(np.concatenate(x).astype(t) if x else np.zeros(0, t)) for n, x, t in zip(("rep", "other", "gap"), out, kinds, strict=True)})

    near = own.unionByName(asks).groupBy("cell", "part").applyInArrow(search, "rep long, other long, gap double")
    near = near.groupBy("rep", "other").agg(F.min("gap").alias("gap"))
    best = Window.partitionBy("rep").orderBy("gap", "other")
    near = near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).select("rep", "other")
    near = near.unionAll(sought.select("rep", F.col("rep").alias("other"))).distinct()

    theirs = found.select(F.col("rep").alias("other"), F.col("vector").alias("v"), "members")
    both = near.join(theirs, "other").join(found.select("rep", F.col("vector").alias("u")), "rep")
    gap = F.aggregate(F.zip_with("u", "v", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    rows = both.select("rep", F.sqrt(gap).alias("score"), F.explode("members").alias("m")).select("rep", "score", "m.vec_id", F.col("m.uid").alias("other"))
    order = Window.partitionBy("rep").orderBy("score", "vec_id", "other")
    rows = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    answers = asked.join(rows.select("rep", "score", "vec_id", "other"), "rep").where("uid <> other")
    final = Window.partitionBy("uid").orderBy("score", "vec_id", "other")
    return answers.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def raw_vectors(kind: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [x.tobytes() for x in vectors(b.column(1), size).astype(kind)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], names=["rep", "vector"])

    return run


def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a partition with its number, and how many rows that are no probes stand before each."""
    part, before = TaskContext.get().partitionId(), 0
    for b in batches:
        real = b.column(b.schema.get_field_index("probe")).to_numpy() == 0
        at = before + np.cumsum(real) - real
        before += int(real.sum())
        cols = [b.column(0), pa.array(np.full(b.num_rows, part, np.int32)), pa.array(at.astype(np.int64)), *b.columns[4:]]
        yield pa.RecordBatch.from_arrays(cols, names=["curve", "part", "at", "rep", "probe", "vector"])
