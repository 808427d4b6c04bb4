"""Packing ordered items into chunks of limited size.

The flush rule looks at the open chunk first: it is closed when it has reached the target, or when the next item would
take it beyond the maximum; items are never split (texts: only pieces longer than the maximum).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut


class Segment:
    """A run of a group's items, and what becomes of a fold that enters it.

    An open chunk of u characters is closed before the first item that finds it at the target or that it can't take.
    From there on nothing depends on u any more, so for each item before which that can happen (those among the
    first `most` characters) the number of later closings and the size of the last chunk say it all.
    """

    def __init__(self, sizes: list[int], target: int, most: int):
        self.sizes, self.target, self.most = sizes, target, most
        n = len(sizes)
        sums = [0, *accumulate(sizes)]
        after, last = [0] * n, [0] * n
        for i in range(n - 1, -1, -1):
            # a chunk that starts at i reaches the target with item j; if j takes it too far, j starts the next one
            j = bisect_left(sums, sums[i] + target, i + 1) - 1
            if j >= n:
                after[i], last[i] = 0, sums[n] - sums[i]
                continue
            following = j + 1 if j == i or sums[j + 1] - sums[i] <= most else j
            after[i], last[i] = (after[following] + 1, last[following]) if following < n else (0, sums[n] - sums[i])
        head = min(n, bisect_left(sums, most) + 1)
        self.sums, self.after, self.last, self.total = sums[: head + 1], after[:head], last[:head], sums[n]


def entered(used: int, sums: list[int], after: list[int], last: list[int], total: int, target: int, most: int) -> tuple[int, int]:
    """(closings, size of the open chunk) when a fold with an open chunk of `used` has gone through a segment."""
    if not used:
        return after[0], last[0]
    # before item j: at the target already, or too large with it
    full = bisect_left(sums, target - used) if used < target else 0
    over = bisect_right(sums, most - used) - 1
    j = min(full, max(over, 0))
    return (1 + after[j], last[j]) if j < len(after) else (0, used + total)


def pack_ordered(df: DataFrame, group: str, order: str, size: str, target: int, most: int) -> DataFrame:
    """group, order, size with `chunk` (from 1) and `oversized`; items without size are left out.

    The fold over a group runs in parallel: rows are range-partitioned by (group, order), every run of a group in a batch
    is a segment, each segment says what a fold does that enters it, one short fold over the segments
    gives each its entry state, and the segments are then folded from there.
    """
    kinds = dict(df.dtypes)
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    items = df.select(group, order, F.col(size).cast("long").alias(size)).where(F.col(size) > 0)
    rows = items.repartitionByRange(parts, group, order).sortWithinPartitions(group, order)

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, batch = TaskContext.get().partitionId(), 0
        for pdf in batches:
            if pdf.empty:
                continue
            g = pdf[group]
            edges = [0, *(i for i in range(1, len(g)) if g.iat[i] != g.iat[i - 1] and not (pd.isna(g.iat[i]) and pd.isna(g.iat[i - 1]))), len(g)]
            out = []
            for a, z in pairwise(edges):
                sizes = pdf[size].iloc[a:z].tolist()
                s = Segment(sizes, target, most)
                out.append((g.iat[a], part, batch, pdf[order].iloc[a:z].tolist(), sizes, s.sums, s.after, s.last, s.total))
            batch += 1
            yield pd.DataFrame(out, columns=["g", "part", "batch", "orders", "sizes", "sums", "after", "last", "total"])

    longs = "array<long>"
    made = cut(rows.mapInPandas(segments, f"g {kinds[group]}, part int, batch int, orders array<{kinds[order]}>, sizes {longs}, sums {longs}, after {longs}, last {longs}, total long"))

    def entries(pdf: pd.DataFrame) -> pd.DataFrame:
        used, chunk, out = 0, 1, []
        for r in pdf.sort_values(["part", "batch"]).itertuples():
            out.append((r.part, r.batch, r.g, used, chunk))
            closed, used = entered(used, list(r.sums), list(r.after), list(r.last), r.total, target, most)
            chunk += closed
        return pd.DataFrame(out, columns=["part", "batch", "g", "used", "chunk"])

    states = made.drop("orders", "sizes").groupBy("g").applyInPandas(entries, f"part int, batch int, g {kinds[group]}, used long, chunk long")
    states = states.select("part", "batch", F.col("g").alias("_g"), "used", "chunk")
    joined = made.select("g", "part", "batch", "orders", "sizes").alias("m").join(states.alias("s"), ["part", "batch"]).where(F.col("g").eqNullSafe(F.col("_g")))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cols: dict[str, list] = {group: [], order: [], size: [], "chunk": [], "oversized": []}
            for r in pdf.itertuples():
                used, chunk = r.used, r.chunk
                for s in r.sizes:
                    if used and (used >= target or used + s > most):
                        chunk, used = chunk + 1, 0
                    used += s
                    cols["chunk"].append(chunk)
                    cols["oversized"].append(s > most)
                cols[group] += [r.g] * len(r.sizes)
                cols[order] += list(r.orders)
                cols[size] += list(r.sizes)
            yield pd.DataFrame(cols)

    return joined.select("g", "orders", "sizes", "used", "chunk").mapInPandas(fold, f"{group} {kinds[group]}, {order} {kinds[order]}, {size} long, chunk long, oversized boolean")


def offsets(packed: DataFrame, group: str, order: str, size: str) -> DataFrame:
    """packed with `start` and `stop`, running sums over the group's order."""
    stop = F.sum(size).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return packed.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col(size))


def text_units(text, most: int):
    """A text's lines with their ends, longer ones in pieces of `most`."""
    parts = F.split(text, "(?<=\n)")
    pieces = F.transform(parts, lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(x) / most) - 1, F.lit(0)).cast("int")), lambda k: F.substr(x, k * most + 1, F.lit(most))))
    return F.filter(F.flatten(pieces), lambda x: x != "")


def pack_text(df: DataFrame, key: str, text: str, target: int, most: int) -> DataFrame:
    """key, chunk, start, stop, body: lossless chunks of each text, none longer than `most`.

    A fold over the text's units inside one expression; what it carries is the list of chunk lengths.
    """
    start = F.struct(F.array().cast("array<long>").alias("done"), F.lit(0).cast("long").alias("used"))

    def step(acc, unit):
        n = F.length(unit).cast("long")
        full = (acc["used"] > 0) & ((acc["used"] >= target) | (acc["used"] + n > most))
        done = F.when(full, F.concat(acc["done"], F.array(acc["used"]))).otherwise(acc["done"])
        return F.struct(done.alias("done"), (F.when(full, F.lit(0)).otherwise(acc["used"]) + n).cast("long").alias("used"))

    sizes = F.aggregate(text_units(F.col(text), most), start, step, lambda acc: F.filter(F.concat(acc["done"], F.array(acc["used"])), lambda x: x > 0))
    rows = df.select(key, F.col(text).alias("_text"), sizes.alias("_sizes"))

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cols: dict[str, list] = {key: [], "chunk": [], "start": [], "stop": [], "body": []}
            for k, body, n in zip(pdf.iloc[:, 0], pdf["_text"], pdf["_sizes"], strict=True):
                if n is None or not len(n):
                    continue
                stop = [0, *accumulate(n.tolist())]
                cols[key] += [k] * len(n)
                cols["chunk"] += range(1, len(n) + 1)
                cols["start"] += stop[:-1]
                cols["stop"] += stop[1:]
                cols["body"] += [body[x:y] for x, y in pairwise(stop)]
            if cols["chunk"]:
                yield pd.DataFrame(cols)

    kind = df.schema[key].dataType.simpleString()
    return rows.mapInPandas(cut_up, f"{key} {kind}, chunk long, start long, stop long, body string")


def batches(df: DataFrame, group: str, order: list[str], size: int = 20) -> DataFrame:
    """df with `batch` (from 0) of `size` rows in the group's order."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1) / size))


# ---------------------------------------------------------------- evidence that shares domains


def pack_graph(methods: DataFrame, domains: DataFrame, target: int, most: int) -> DataFrame:
    """page, chunk, method, oversized: methods of each page grouped so that shared domain types are sent once.

    methods: page, ord, method, chars. domains: page, method, domain, chars. Methods beyond `most` are chunks of their own.
    A chunk is seeded with the domain whose sharing saves most, grows by its methods while they fit, and is filled
    with the methods that overlap it most until it has the target; what shares nothing is packed in order; at
    last pairs of chunks that still fit together merge, those of greatest overlap first.

    Each choice depends on the ones before it, so a page is one task. It holds the page's methods with their domains and, for what has been packed
    so far, sums by method or chunk: memory grows with the page's rows, not with methods times domains or with pairs of chunks.
    """

    def one_page(key, ms: pa.Table, ds: pa.Table) -> pa.Table:
        ms = ms.sort_by([("ord", "ascending"), ("method", "ascending")]).combine_chunks()
        methods = ms["method"].to_pylist()
        place = {m: i for i, m in enumerate(methods)}
        names, named = codes(ds["domain"])
        by_name = pc.sort_indices(named).to_numpy()
        rank = np.empty(len(named), np.int64)
        rank[by_name] = np.arange(len(named))
        column = rank[names]
        weight = np.zeros(len(named), np.int64)
        weight[column] = ds["chars"].to_numpy()
        of, known = codes(ds["method"])
        row = np.array([place.get(m, -1) for m in known.to_pylist()], np.int64)[of]
        has = domain_lists(row[row >= 0], column[row >= 0], len(methods))
        chars = ms["chars"].to_numpy().astype(np.int64)
        large = chars + np.array([weight[d].sum() for d in has], np.int64) > most
        groups = [(g, False) for g in merged_groups(shared_groups(has, weight, chars, ~large, target, most), has, weight, chars, most)]
        groups += [([i], True) for i in np.nonzero(large)[0]]
        rows = [(n, methods[i], over) for n, (g, over) in enumerate(groups, 1) for i in g]
        kinds = {"chunk": pa.int64(), "method": pa.string(), "oversized": pa.bool_()}
        cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())]
        return pa.table([pa.array([key[0].as_py()] * len(rows), pa.int64()), *cols], ["page", *kinds])

    by = methods.select("page", "ord", "method", "chars").groupBy("page").cogroup(domains.select("page", "method", "domain", "chars").groupBy("page"))
    return by.applyInArrow(one_page, "page long, chunk long, method string, oversized boolean")


def codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The column's values as places among its distinct ones, and these."""
    whole = column.combine_chunks().dictionary_encode()
    whole = whole.combine_chunks() if isinstance(whole, pa.ChunkedArray) else whole
    return whole.indices.to_numpy(), whole.dictionary


def domain_lists(row: np.ndarray, column: np.ndarray, n: int) -> list[np.ndarray]:
    """The distinct columns of each of n rows, in order."""
    order = np.lexsort((column, row))
    row, column = row[order], column[order]
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (column[1:] != column[:-1])))[: len(row)]
    return np.split(column[new], np.searchsorted(row[new], np.arange(1, n))) if n else []


def held_by(lists: list[np.ndarray], n: int) -> list[np.ndarray]:
    """The other way round: for each of n columns the rows that have it, in order."""
    row, column = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate([np.zeros(0, np.int64), *lists])
    return domain_lists(column, row, n)


def shared_groups(has: list[np.ndarray], weight: np.ndarray, chars: np.ndarray, free: np.ndarray, target: int, most: int) -> list[list[int]]:
    """Methods that are free, in groups seeded by the domains whose sharing saves most. has: each method's domains."""
    free, n = free.copy(), len(has)
    holders = held_by(has, len(weight))
    joined = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
    uses = np.bincount(joined([has[i] for i in np.nonzero(free)[0]]), minlength=len(weight))
    first = np.array([next((i for i in x if free[i]), n) for x in holders], np.int64)
    whole = chars + np.array([weight[d].sum() for d in has], np.int64)
    # what every method has in common with the group: in characters, and as the gain that ranks it; kept up as domains are added
    common, gain = np.zeros(n, np.int64), np.zeros(n, np.int64)
    out = []
    while True:
        saved = np.where(uses > 1, weight * (uses - 1), 0)
        if not len(saved) or (top := saved.max()) <= 0:
            break
        worth = np.nonzero(saved == top)[0]
        seed = worth[np.lexsort((worth, first[worth], -uses[worth]))[0]]  # columns are in the order of names
        group, size, sent, met = [], 0, set(), []

        def add(i: int) -> bool:
            nonlocal size
            more = whole[i] - common[i]
            if size + more > most:
                return False
            size += more
            group.append(int(i))
            new = np.array([d for d in has[i].tolist() if d not in sent], np.int64)
            near = [holders[d] for d in new]
            rows, each = joined(near), np.repeat(weight[new], [len(x) for x in near])
            np.add.at(common, rows, each)
            np.add.at(gain, rows, np.maximum(each, 1))
            met.append(rows)
            sent.update(new.tolist())
            free[i] = False
            return True

        for i in holders[seed][free[holders[seed]]]:
            add(i)
        while size < target:
            near = np.unique(joined(met))
            met[:] = [near[free[near]]]
            near = met[0][(gain[met[0]] > 0) & (size + whole[met[0]] - common[met[0]] <= most)]
            if not len(near):
                break
            add(near[np.argmax(gain[near])])  # the first of those of greatest gain
        np.subtract.at(uses, joined([has[i] for i in group]), 1)
        for d in sent:
            rows = holders[d]
            common[rows] = gain[rows] = 0
            there = rows[free[rows]]
            first[d] = there[0] if len(there) else n
            holders[d] = there  # those that have gone play no part from here on
        out.append(group)
    group, size, sent = [], 0, set()
    for i in np.nonzero(free)[0]:
        more = chars[i] + sum(int(weight[d]) for d in has[i].tolist() if d not in sent)
        if group and (size >= target or size + more > most):
            out.append(group)
            group, size, sent = [], 0, set()
            more = whole[i]
        group.append(int(i))
        size += more
        sent.update(has[i].tolist())
    return out + [group] * bool(group)


def merged_groups(groups: list[list[int]], has: list[np.ndarray] | np.ndarray, weight: np.ndarray, chars: np.ndarray, most: int) -> list[list[int]]:
    """Groups joined two by two while any two fit together: greatest overlap first, then the fullest result, the smaller source, the earliest places.

    has: each method's domains, or flags. Of every group only the best later partner that it shares domains with is held; where none is left that
    fits, the pair that fills up best is found by size.
    """
    has = has if isinstance(has, list) else [np.nonzero(x)[0] for x in has]
    groups = [list(g) for g in groups]
    n = len(groups)
    if not n:
        return []
    sent = [np.unique(np.concatenate([np.zeros(0, np.int64), *[has[i] for i in g]])) for g in groups]
    holders = held_by(sent, len(weight))
    size = np.array([chars[g].sum() + weight[d].sum() for g, d in zip(groups, sent, strict=True)], np.int64)
    count, alive = np.array([len(g) for g in groups]), np.ones(n, bool)
    # of each group's pairs with later ones: what the best has in common (-1: none fits), its slack, the smaller count, the partner
    overlap, slack, least, partner = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1)

    def fits(i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Groups that share domains with i and fit together with it: places, what is in common, slack, smaller count."""
        near = [holders[d] for d in sent[i]]
        rows = np.concatenate([np.zeros(0, np.int64), *near])
        shared = np.bincount(rows, np.repeat(weight[sent[i]], [len(x) for x in near]), n).astype(np.int64)  # whole numbers, exact below 2 ** 53
        at = np.unique(rows)
        left = most - (size[at] + size[i] - shared[at])
        at, left = (x[alive[at] & (at != i) & (shared[at] > 0) & (left >= 0)] for x in (at, left))
        return at, shared[at], left, np.minimum(count[at], count[i])

    def look(i: int, found=None) -> None:
        at, shared, left, small = found or fits(i)
        later = np.nonzero(at > i)[0]
        if not len(later):
            overlap[i], partner[i] = -1, -1
            return
        pick = later[np.lexsort((at[later], small[later], left[later], -shared[later]))[0]]
        overlap[i], slack[i], least[i], partner[i] = shared[pick], left[pick], small[pick], at[pick]

    for i in range(n):
        look(i)
    while True:
        if (top := overlap.max()) > 0:
            rows = np.nonzero(overlap == top)[0]
            i = int(rows[np.lexsort((rows, least[rows], slack[rows]))[0]])
            j = int(partner[i])
        elif (pair := fullest(np.nonzero(alive)[0], size, count, most)) is not None:
            i, j = pair
        else:
            return [g for g, there in zip(groups, alive, strict=True) if there]
        size[i] += size[j] - max(top, 0)
        groups[i] += groups[j]
        new = np.setdiff1d(sent[j], sent[i])
        for d in sent[j]:
            holders[d] = holders[d][holders[d] != j]
        for d in new:
            holders[d] = np.append(holders[d], i)
        sent[i], sent[j] = np.union1d(sent[i], new), np.zeros(0, np.int64)
        count[i] += count[j]
        alive[j] = False
        overlap[j] = partner[j] = -1
        found = fits(i)
        look(i, found)
        for k in np.nonzero(((partner == i) | (partner == j)) & alive)[0]:
            if k != i:
                look(int(k))
        for k, shared, left, small in zip(*(x.tolist() for x in found), strict=True):
            if k < i and (-shared, left, small, i) < ((-overlap[k], slack[k], least[k], partner[k]) if overlap[k] > 0 else (0, 0, 0, 0)):
                overlap[k], slack[k], least[k], partner[k] = shared, left, small, i


def fullest(at: np.ndarray, size: np.ndarray, count: np.ndarray, most: int) -> tuple[int, int] | None:
    """Of two groups that fit together and have nothing in common those that fill up best, then with the smaller source, at the earliest places. at: places, in order."""
    at = at[size[at] <= most - size[at].min(initial=most)]
    order = np.lexsort((at, size[at]))
    by, sizes = at[order], size[at][order]
    # the largest partner of each, not itself
    partner = np.searchsorted(sizes, most - sizes, "right") - 1
    partner -= partner == np.arange(len(by))
    ok = partner >= 0
    if not ok.any():
        return None
    best = int((sizes[ok] + sizes[partner[ok]]).max())
    # all groups in pairs of that size: the first two places of each size are enough
    low, high = np.searchsorted(sizes, best - sizes, "left"), np.searchsorted(sizes, best - sizes, "right")
    own = np.nonzero(high - low > (sizes * 2 == best))[0]
    own = own[count[by[own]] == count[by[own]].min()]
    other = np.where(by[low[own]] == by[own], by[np.minimum(low[own] + 1, len(by) - 1)], by[low[own]])
    i, j = np.minimum(by[own], other), np.maximum(by[own], other)
    pick = np.lexsort((j, i))[0]
    return int(i[pick]), int(j[pick])
