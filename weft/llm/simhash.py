"""SimHash near-duplicates by the generalised pigeonhole principle (operator 5).

A document's fingerprint has a bit set where over half of its word-shingle hashes have it set. Two
fingerprints link at `radius` or fewer differing bits; a document's class is its connected component.

Links are found among distinct fingerprints only, so exact copies cost one row:

1. Bits are grouped into partitions, correlated bits together, from bit counts over all fingerprints.
2. Each partition gets its own threshold, from -1 (not probed) upwards. If the thresholds t_i fulfil
   sum(t_i + 1) = radius + 1, two fingerprints within the radius agree to within t_i in some
   partition i. Dynamic programming picks the t_i of least cost; the candidate counts behind it
   are the collisions counted per partition, scaled to t_i flips by the bits' measured balance. The
   number of partitions is the one of least total cost.
3. Every fingerprint goes to the cell of its own bits in each partition, and to the cells within t_i flips.
   Cells are verified with one XOR and popcount per pair. Large cells are split into blocks, and each pair
   of blocks is a row of its own, so no task holds a cell. Of the links in a cell only a spanning forest
   leaves it: no group emits its pairs, and no component changes.
4. Components: smallest label by repeated joins with pointer jumping, each round written to the shared folder; hubs are dealt over several tasks.

Defined cases: a null text counts as empty; a text without words has fingerprint zero and links like any
other; rows with a null id keep their row and link by their text, and a class that has no id at all
gets a null component; repeated rows stay; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql import types as T

from ._common import LOWER, discard, looked_up, only_id_text, slices, stored, texts, unused

BITS = 64


def shingle_hashes(words: list[bytes], width: int, seed: int) -> np.ndarray:
    """XXH64 of every run of `width` words (of all words, if fewer), space-joined."""
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    width = min(width, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], "<u8")


def majority(h: np.ndarray) -> np.ndarray:
    """The bits set in over half the hashes (rows of h, one or more 64-bit words each), as words."""
    h = h.reshape(len(h), -1)
    bits = BITS * h.shape[1]
    counts = np.zeros(bits, np.int64)
    for at in range(0, len(h), 1 << 14):
        part = np.ascontiguousarray(h[at : at + (1 << 14)]).view(np.uint8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(h), bitorder="little").view("<u8")


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    words = text.translate(LOWER).split()
    return int(majority(shingle_hashes(words, width, seed))[0]) if words else 0


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.array([fingerprint(t, width, seed) for t in texts(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return only_id_text(docs).mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------- partitions and thresholds


def bit_moments(fps: DataFrame, names: list[str]) -> tuple[int, np.ndarray]:
    """How many rows there are, and for each word how often each pair of its bits is set together; 64 x 64 numbers a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((len(names), BITS, BITS))
        n = 0
        for b in batches:
            for k in range(len(names)):
                fp = b.column(k).to_numpy(zero_copy_only=False).view(np.uint64)
                bits = np.unpackbits(fp.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, BITS).astype(np.float32)
                both[k] += bits.T @ bits
            n += b.num_rows
        cells = pa.array(np.concatenate(([n], both.ravel())).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(both.size + 1)), cells], names=["cell", "n"])

    sums = np.zeros(len(names) * BITS * BITS + 1)
    for r in fps.select(*names).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        sums[r["cell"]] = r["n"]
    return int(sums[0]), sums[1:].reshape(-1, BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of near-equal size; each grows by the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    strength = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(strength, 0)
    free, groups = list(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        seed = free[int(np.argmax(strength[np.ix_(free, free)].sum(1)))]
        group = [seed]
        free.remove(seed)
        while len(group) < size:
            best = free[int(np.argmax(strength[np.ix_(free, group)].sum(1)))]
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def within(n: int, both: np.ndarray, group: list[int], most: int) -> np.ndarray:
    """Chance that two fingerprints differ in exactly 0, 1, .. `most` bits of the group, bits taken as independent."""
    p = np.clip(np.diag(both)[group] / max(n, 1), 1e-6, 1 - 1e-6)
    chance = np.zeros(most + 1)
    chance[0] = 1
    for q in 2 * p * (1 - p):
        chance = chance * (1 - q) + np.concatenate(([0], chance[:-1])) * q
    return chance


def allocate(costs: list[list[float]], units: int) -> tuple[float, list[int]]:
    """Thresholds t_i with sum(t_i + 1) = units and least sum of costs[i][t_i + 1]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for u, extra in enumerate(options):
                if used + u <= units and (used + u not in nxt or c + extra < nxt[used + u][0]):
                    nxt[used + u] = (c + extra, [*ts, u - 1])
        best = nxt
    return best[units]


def project(fp, group: list[int]):
    """The bits of a group as one masked value; groups are told apart by their number."""
    mask = sum(1 << b for b in group)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def plan(fps: DataFrame, radius: int, choices: tuple[int, ...] = (2, 3, 4, 5), probe_cost: float = 30.0) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each probed partition. A probe row costs about as much as `probe_cost` verified pairs."""
    n, (both,) = bit_moments(fps, ["fp"])
    groups = {m: group_bits(n, both, m) for m in choices if m <= radius + 1}
    flat = [(m, i, g) for m, gs in groups.items() for i, g in enumerate(gs)]
    keyed = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), project(F.col("fp"), g).alias("key")) for k, (_, _, g) in enumerate(flat)]))
    counts = fps.select(keyed.alias("x")).select("x.k", "x.key").groupBy("k", "key").agg(F.count("*").alias("c"))
    same = {r["k"]: float(r["pairs"]) for r in counts.groupBy("k").agg(F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2).alias("pairs")).collect()}
    found = []
    for m, gs in groups.items():
        costs = []
        for i, g in enumerate(gs):
            k = next(k for k, x in enumerate(flat) if x[:2] == (m, i))
            chance = within(n, both, g, radius)
            pairs = max(same.get(k, 0.0), n * n / 2 * chance[0])
            row = [0.0]
            for t in range(radius + 1):
                ball = sum(math.comb(len(g), j) for j in range(t + 1))
                row.append(pairs * chance[: t + 1].sum() / max(chance[0], 1e-300) + probe_cost * n * ball)
            costs.append(row)
        cost, ts = allocate(costs, radius + 1)
        found.append((cost, m, [(g, t) for g, t in zip(gs, ts, strict=True) if t >= 0]))
    return min(found, key=lambda x: x[:2])[2]


def flips(group: list[int], most: int) -> list[int]:
    """XOR masks of 1 to `most` bits of the group, as signed longs."""
    masks, last = [], [0]
    for _ in range(most):
        last = sorted({m | 1 << b for m in last for b in group if not m >> b & 1})
        masks += last
    return [m - (1 << 64) if m >> 63 else m for m in masks]


# ---------------------------------------------------------------- candidate cells


def stars(fp: np.ndarray, node: np.ndarray, own: int, radius: int) -> list[tuple[int, int]]:
    """(one member, another) with the components of all links within `radius` bits of which at least one end is among the first `own` rows.

    fp: rows x words. With several words, a pair within the radius is within its half on one half of the words, so that is asked first.
    """
    n, words = fp.shape
    near, held, step = [], 0, max(1, (1 << 20) // max(n, 1))
    cols = np.ascontiguousarray(fp.T)
    for at in range(0, own, step):
        d = [np.bitwise_count(c[at : min(at + step, own), None] ^ c[None, :]) for c in cols]
        if words == 1:
            x, y = np.nonzero(d[0] <= radius)
        else:
            half = words // 2
            x, y = np.nonzero((sum(d[:half]) <= radius // 2) | (sum(d[half:]) <= radius // 2))
            close = sum(e[x, y].astype(np.int64) for e in d) <= radius
            x, y = x[close], y[close]
        x = x + at
        up = (x < y) & (node[x] != node[y])
        near.append((x[up], y[up]))
        held += len(near[-1][0])
        if held > 1 << 20:  # a dense cell: keep only what the links amount to
            near = [merged(n, near)]
            held = len(near[0][0])
    if not held:
        return []
    roots, members = merged(n, near)
    return list(zip(node[roots].tolist(), node[members].tolist(), strict=True))


def merged(n: int, links: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Stars (root, member) with the same components as the links over nodes 0 to n - 1."""
    x, y = np.concatenate([p for p, _ in links]), np.concatenate([q for _, q in links])
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    members = np.nonzero(label != np.arange(n))[0]
    return label[members], members


def cell_links(rows: DataFrame, names: list[str], radius: int, block: int) -> DataFrame:
    """a, b: pairs of nodes with the components of all links that meet in a cell.

    rows: part, key (the cell), probe (whether the row only looks in), node, and its words `names`. A cell of more than `block` rows is split
    into blocks, and each pair of blocks is a row of its own.
    """
    big = stored(rows.groupBy("part", "key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1"))
    cells = rows.join(big, ["part", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    span = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("mine"), o).alias("low"), F.greatest(F.col("mine"), o).alias("high")))
    fields = F.struct("node", *names)
    cells = cells.withColumn("mine", mine).select("part", "key", "probe", fields.alias("row"), F.explode(span).alias("cell"))
    packed = cells.groupBy("part", "key", "cell").agg(F.collect_list(F.when(~F.col("probe"), F.col("row"))).alias("own"), F.collect_list(F.when(F.col("probe"), F.col("row"))).alias("other"))
    packed = packed.where((F.size("own") > 0) & (F.size("own") + F.size("other") > 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: set[tuple[int, int]] = set()
            sides = []
            for c in (b.column(0), b.column(1)):
                cols = [x.to_numpy(zero_copy_only=False) for x in c.values.flatten()]
                sides.append((c.offsets.to_numpy(), cols[0], np.stack([x.view(np.uint64) for x in cols[1:]], 1)))
            (oo, on, of), (po, pn, pf) = sides
            for i in range(b.num_rows):
                o, p = slice(oo[i], oo[i + 1]), slice(po[i], po[i + 1])
                found = stars(np.concatenate((of[o], pf[p])), np.concatenate((on[o], pn[p])), o.stop - o.start, radius)
                out.update(found)
            x = np.array(sorted(out), np.int64).reshape(-1, 2)
            if len(x):  # cells have members in common: one star for all that hangs together in the batch
                ids, at = np.unique(x, return_inverse=True)
                at = at.reshape(-1, 2)
                x = ids[np.column_stack(merged(len(ids), [(at[:, 0], at[:, 1])]))]
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])

    return packed.select("own", "other").mapInArrow(run, "a long, b long").distinct()


def dealt(nodes: DataFrame, names: list[str], parts: list[tuple[str, list[int], int]]) -> DataFrame:
    """Every node in the cell of its own bits of each part (word, bits, flips), and as a probe in those within so many flips; one scan of nodes."""
    cells = [
        F.struct(F.lit(k).alias("part"), project(F.col(word), group).alias("key"), F.array(*[F.lit(m).cast("long") for m in [0, *flips(group, max(t, 0))]]).alias("flips"))
        for k, (word, group, t) in enumerate(parts)
    ]
    rows = nodes.select("node", *names, F.explode(F.array(*cells)).alias("cell")).select("node", *names, "cell.part", "cell.key", F.explode("cell.flips").alias("flip"))
    return rows.select("part", F.col("key").bitwiseXOR(F.col("flip")).alias("key"), (F.col("flip") != 0).alias("probe"), "node", *names)


def links(fps: DataFrame, radius: int = 4, block: int = 8192, choices: tuple[int, ...] = (2, 3, 4, 5)) -> DataFrame:
    """a, b: pairs of distinct fingerprints, all within chains of links, that have the components of all links."""
    parts = [("fp", g, t) for g, t in plan(fps, radius, choices)]
    return cell_links(dealt(fps.withColumn("node", F.col("fp")), ["fp"], parts), ["fp"], radius, block)


def thinned(edges: DataFrame, most: int = 1 << 20) -> DataFrame:
    """a, b: stars with the components of edges (a, b). Each slice of about `most` edges sends on a star for all that hangs together in it, as often as that halves them.

    So a node has a link for each slice that knows it, not for each cell in which it was met.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns]))
            size += b.num_rows
            if size >= 2 * most:
                held = [stars_of(np.concatenate(held))]
                size = len(held[0])
                if size >= most:
                    yield sent(held[0])
                    held, size = [], 0
        if size:
            yield sent(stars_of(np.concatenate(held)))

    def stars_of(x: np.ndarray) -> np.ndarray:
        ids, at = np.unique(x, return_inverse=True)
        at = at.reshape(-1, 2)
        roots, members = merged(len(ids), [(at[:, 0], at[:, 1])])
        alone = np.ones(len(ids), bool)
        alone[roots] = alone[members] = False  # linked with itself only
        return ids[np.column_stack((np.concatenate((roots, np.nonzero(alone)[0])), np.concatenate((members, np.nonzero(alone)[0]))))]

    def sent(x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])

    rows = stored(edges.select("a", "b"))
    left = rows.count()
    while True:
        before, was = rows, left
        rows = stored(before.coalesce(max(1, -(-was // most))).mapInArrow(run, "a long, b long"))
        left = rows.count()
        discard(before)
        if left <= most or 2 * left > was:
            return rows


def components(edges: DataFrame, most: int = 1 << 16) -> DataFrame:
    """node, label (smallest node reachable) for all nodes of edges (a, b).

    Labels take the minimum over their neighbours and then over their label's label, until none changes. A node of over `most` edges
    answers from several copies, so a giant class is no single task's work.
    """
    edges = thinned(edges)
    both = stored(edges.select("a", "b").unionAll(edges.select(F.col("b"), F.col("a"))).distinct())
    discard(edges)
    hubs = stored(both.groupBy(F.col("b").alias("node")).agg(F.ceil(F.count("*") / most).cast("int").alias("salts")).where("salts > 1"))
    salted = not hubs.isEmpty()
    if salted:
        salts = F.coalesce("salts", F.lit(1))
        plain = both
        both = stored(both.join(hubs, both["b"] == hubs["node"], "left").select("a", "b", F.pmod(F.xxhash64("a"), salts).cast("int").alias("salt")))
        discard(plain)
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        by = labels.select(F.col("node").alias("b"), F.col("label").alias("other"))
        if salted:
            copies = by.join(hubs, by["b"] == hubs["node"], "left").select("b", "other", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
            near = both.join(copies, ["b", "salt"])
        else:
            near = both.join(by, "b")
        near = near.groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "other").alias("label"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        if salted:
            step = stored(step)
            jump = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
            new = looked_up(step, jump, "label", "left", most)
        else:
            new = step.join(jump, "label", "left")
        new = stored(new.select("node", "was", F.least("label", F.coalesce("further", "label")).alias("label")))
        changed = not new.where("was <> label").isEmpty()
        discard(labels, *([step] if salted else []))
        labels = new
        if not changed:
            discard(both, hubs)
            return labels.select("node", "label")


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, seed: int = 42, block: int = 8192) -> DataFrame:
    """doc_id, fp, component_id for every row."""
    rows = stored(fingerprints(docs, width, seed))
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    labels = components(links(fps.select("fp"), radius, block))
    fps = fps.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    fps = stored(fps)
    firsts = fps.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = looked_up(fps, firsts, "label").select("fp", "component_id")
    return looked_up(rows, named, "fp").select("doc_id", "fp", "component_id")


def as_hex(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ---------------------------------------------------------------- groups of verified similarity

WORDS = 4  # 64-bit words of the long fingerprint
NAMES = [f"w{k}" for k in range(WORDS)]
STIR = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)


def long_fingerprint(h: np.ndarray) -> np.ndarray:
    """Majority over the distinct shingles (their XXH64), since links are verified on sets of them."""
    h = h.astype(np.uint64)[:, None] * STIR[None, :]
    h ^= h >> np.uint64(31)
    h *= STIR[::-1][None, :]
    h ^= h >> np.uint64(29)
    return majority(h.astype("<u8"))


def shingle_set(words: list[bytes], width: int, seed: int) -> np.ndarray:
    return np.unique(shingle_hashes(words, width, seed)) if words else np.zeros(0, "<u8")


def wording(words: list[bytes]) -> bytes:
    """MD5 of the lower-cased words: copies share it."""
    return hashlib.md5(b" ".join(words)).digest()


def signatures(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """doc_id, words (their MD5) and the long fingerprint w0 .. w3."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp, same = np.zeros((b.num_rows, WORDS), np.uint64), []
            for i, t in enumerate(texts(b)):
                words = t.translate(LOWER).split()
                if words:
                    fp[i] = long_fingerprint(shingle_set(words, width, seed))
                same.append(wording(words))
            bits = fp.view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(same, pa.binary()), *(pa.array(bits[:, k].copy()) for k in range(WORDS))], names=["doc_id", "words", *NAMES])

    return docs.mapInArrow(run, "doc_id long, words binary, " + ", ".join(f"{w} long" for w in NAMES))


def with_wording(docs: DataFrame, name: str) -> DataFrame:
    """docs and the MD5 of each text's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.append_column(name, pa.array([wording(t.translate(LOWER).split()) for t in texts(b)], pa.binary()))

    return docs.mapInArrow(run, T.StructType([*(T.StructField(f.name, f.dataType) for f in docs.schema.fields), T.StructField(name, T.BinaryType())]))


def shingle_sets(rows: DataFrame, width: int, seed: int) -> DataFrame:
    """family, node, bag (sorted XXH64 of the distinct shingles, packed) of rows (family, node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            bags = [shingle_set(t.translate(LOWER).split(), width, seed).tobytes() for t in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bags, pa.binary())], names=["family", "node", "bag"])

    return rows.select("family", "node", "text").mapInArrow(run, "family long, node long, bag binary")


def sure_plan(nodes: DataFrame, threshold: float, sure: float, choices: tuple[int, ...] = (3, 4, 5, 6, 7, 8), probe_cost: float = 200.0) -> list[tuple[str, list[int], int]]:
    """(word, bits, flips) of each probed partition, so that two sets at the threshold meet in one with a chance of at least `sure`.

    Sets of Jaccard similarity s have the cosine 2s / (1 + s), and a bit of their SimHashes differs with a chance of its angle over pi; a
    tenth is added to that for small sets. Dynamic programming gives each partition its flips: the gain of a partition is
    -log(chance to miss there), the sum of gains has to reach -log(1 - sure), the cost is what `within` says of pairs of unlike
    documents, plus the probes. The number of partitions a word is the one of least total cost, so cells get narrower as the table grows.
    """
    n, both = bit_moments(nodes, NAMES)
    apart = 1.1 * math.acos(2 * threshold / (1 + threshold)) / math.pi
    grid, found = 240, []
    aim = -math.log(1 - sure)
    for m in choices:
        flat = [(w, g) for w in range(WORDS) for g in group_bits(n, both[w], m)]
        best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for w, g in flat:
            chance = within(n, both[w], g, 2)
            meet = [sum(math.comb(len(g), j) * apart**j * (1 - apart) ** (len(g) - j) for j in range(t + 1)) for t in range(3)]
            options = [(0, 0.0, -1)]
            for t in range(3):
                ball = sum(math.comb(len(g), j) for j in range(t + 1))
                options.append((int(-math.log(1 - meet[t]) / aim * grid), n * n / 2 * chance[: t + 1].sum() + probe_cost * n * ball, t))
            nxt: dict[int, tuple[float, tuple[int, ...]]] = {}
            for gained, (cost, ts) in best.items():
                for more, extra, t in options:
                    k = min(grid, gained + more)
                    if k not in nxt or cost + extra < nxt[k][0]:
                        nxt[k] = (cost + extra, (*ts, t))
            best = nxt
        if grid in best:
            found.append((best[grid][0], m, [(f"w{w}", g, t) for (w, g), t in zip(flat, best[grid][1], strict=True) if t >= 0]))
    return min(found, key=lambda x: x[:2])[2]


def common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of a shares with each of b; sets are sorted arrays."""
    if len(a) == len(b) == 1:
        return np.array([[len(np.intersect1d(a[0], b[0], assume_unique=True))]])
    x, y = np.concatenate(a), np.concatenate(b)
    of = [np.repeat(np.arange(len(s)), [len(z) for z in s]) for s in (a, b)]
    shared = np.intersect1d(x, y)
    step = max(1, (1 << 22) // max(len(a), len(b)))
    out = np.zeros((len(a), len(b)))
    for at in range(0, len(shared), step):
        part = shared[at : at + step]
        sides = []
        for s, v, rows in ((a, x, of[0]), (b, y, of[1])):
            place = np.minimum(np.searchsorted(part, v), len(part) - 1)
            ok = part[place] == v
            held = np.zeros((len(s), len(part)), np.float32)
            held[rows[ok], place[ok]] = 1
            sides.append(held)
        out += sides[0] @ sides[1].T
    return out


def alike(bags: list[np.ndarray], own: int, threshold: float, tile: int = 256, tile_size: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Stars with the components of all pairs of sets of Jaccard similarity `threshold` or more, one end being among the first `own`.

    Sets are compared in tiles of like sizes; tiles too unlike in size, and those whose sets hang together already, are passed over.
    """
    n = len(bags)
    size = np.array([len(b) for b in bags])
    order = np.argsort(size, kind="stable")
    fill = np.cumsum(size[order])
    tiles, start = [], 0
    for i in range(1, n + 1):
        if i == n or i - start >= tile or fill[i] - (fill[start - 1] if start else 0) > tile_size:
            tiles.append(order[start:i])
            start = i
    label = np.arange(n)
    for i, one in enumerate(tiles):
        for two in tiles[i:]:
            if size[two[0]] * threshold > size[one[-1]] + 1e-9:
                break
            mine = (one[:, None] < own) | (two[None, :] < own)
            if not mine.any() or (label[one] == label[one[0]]).all() and (label[two] == label[one[0]]).all():
                continue
            both = common([bags[k] for k in one], [bags[k] for k in two])
            good = mine & (both >= threshold * (size[one][:, None] + size[two][None, :] - both) - 1e-9)
            x, y = np.nonzero(good)
            x, y = one[x], two[y]
            joins = label[x] != label[y]
            if joins.any():
                stars_of = np.nonzero(label != np.arange(n))[0]
                roots, members = merged(n, [(label[stars_of], stars_of), (x[joins], y[joins])])
                label = np.arange(n)
                label[members] = roots
    members = np.nonzero(label != np.arange(n))[0]
    return label[members], members


def tested(cells: DataFrame, threshold: float) -> DataFrame:
    """a, b: verified links with the components of all that hold in each cell (family, x, y). cells: also own, node, bag."""
    packed = cells.groupBy("family", "x", "y").agg(F.collect_list(F.struct("node", "own", "bag")).alias("rows")).where(F.size("rows") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[], []]
            at, (node, own, bag) = b.column(0).offsets.to_pylist(), b.column(0).values.flatten()
            node, own = node.to_numpy(zero_copy_only=False), own.to_numpy(zero_copy_only=False)
            for i in range(b.num_rows):
                here = slice(at[i], at[i + 1])
                order = np.argsort(~own[here], kind="stable")
                ids = node[here][order]
                bags = [np.frombuffer(bag[at[i] + int(k)].as_py(), "<u8") for k in order]
                for col, x in zip(out, alike(bags, int(own[here].sum()), threshold), strict=True):
                    col.append(ids[x])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) if x else pa.array([], pa.int64()) for x in out], names=["a", "b"])

    return packed.select("rows").mapInArrow(run, "a long, b long").where("a <> b")


def verified(members: DataFrame, threshold: float, block_bytes: int, pivots: int) -> DataFrame:
    """node, label: components of the verified links within families. members: family, node, bag.

    A family of up to `block_bytes` of sets is one cell. A larger one is cut into blocks. First each block is compared with itself and with the family's
    `pivots`, which is linear and joins nearly all of a family of true copies. Then what isn't in the family's largest
    component, the rest, is compared with every block: a link between two components has an end there.
    """
    size = F.octet_length("bag")
    big = stored(members.groupBy("family").agg(F.ceil(F.sum(size) / block_bytes).cast("int").alias("blocks"), F.count("*").alias("n")).where("blocks > 1"))
    blocks = F.coalesce("blocks", F.lit(1))
    cells = members.join(big.select("family", "blocks"), "family", "left").select("family", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("x"), F.lit(-1).alias("y"), F.lit(True).alias("own"), "node", "bag")
    several = not big.isEmpty()
    if several:
        order = Window.partitionBy("family").orderBy(F.xxhash64("node"), "node")
        few = members.select("family", "node").join(big.select("family"), "family", "left_semi").withColumn("r", F.row_number().over(order)).where(F.col("r") <= pivots)
        few = members.join(few.select("node"), "node").join(big, "family").withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cells = cells.unionAll(few.select("family", "x", F.lit(-1), F.lit(False), "node", "bag"))
    found = stored(tested(cells, threshold))
    labels = components(found)
    if several:
        held = members.join(big, "family").select("family", "node", "blocks", "bag").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        held = stored(held)
        counts = held.groupBy("family", "label").agg(F.count("*").alias("c"))
        main = counts.groupBy("family").agg(F.max(F.struct("c", F.col("label").alias("main"))).alias("m")).select("family", "m.main")
        rest = stored(held.join(main, "family").where("label <> main").select("family", "node", "blocks", "bag"))
        many = stored(rest.groupBy("family").agg(F.ceil(F.sum(size) / block_bytes).cast("int").alias("rests")))
        if not many.isEmpty():
            mine = rest.join(many, "family").withColumn("y", F.pmod(F.xxhash64("node", F.lit(1)), F.col("rests")).cast("int"))
            mine = mine.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            theirs = held.join(many, "family").withColumn("x", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
            theirs = theirs.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)))
            cells = mine.select("family", "x", "y", F.lit(True).alias("own"), "node", "bag").unionAll(theirs.select("family", "x", "y", F.lit(False), "node", "bag"))
            more = stored(found.unionAll(tested(cells, threshold)))
            labels, old = components(more), labels
            discard(more)
        discard(held, rest, many)
    discard(found, big)
    return labels


def grouped(docs: DataFrame, width: int, threshold: float, seed: int, radius: int, sure: float, block: int, block_bytes: int, pivots: int) -> tuple[DataFrame, DataFrame]:
    """Of docs (doc_id, text): doc_id and words of every row; words, doc_id (the smallest of it) and label (of its component) of every distinct text."""
    rows = stored(signatures(docs, width, seed))
    nodes = rows.groupBy("words").agg(F.min("doc_id").alias("doc_id"), *(F.first(w).alias(w) for w in NAMES))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()))
    prints = nodes.select("node", *NAMES)
    near = stored(cell_links(dealt(prints, NAMES, sure_plan(prints, threshold, sure)), NAMES, radius, block))
    families = components(near).withColumnRenamed("label", "family")
    wanted = nodes.join(families, "node").select("doc_id", "words", "node", "family").hint("merge")
    sought = with_wording(docs, "words").dropDuplicates(["doc_id", "words"])
    members = stored(shingle_sets(sought.join(wanted, ["doc_id", "words"]), width, seed))
    labels = verified(members, threshold, block_bytes, pivots)
    out = stored(nodes.join(labels, "node", "left").select("words", "doc_id", F.coalesce("label", "node").alias("label")))
    discard(nodes, near, members)
    return rows.select("doc_id", "words"), out


OPTIONS = {"radius": 64, "sure": 0.995, "block": 8192, "block_bytes": 12 << 20, "pivots": 8}


def similar_groups(docs: DataFrame, width: int = 5, threshold: float = 0.8, seed: int = 42, **options) -> DataFrame:
    """doc_id, component_id for every row that has an id: documents linked by shingle similarity of `threshold` or more.

    Copies (equal lower-cased words) are one node. Candidates meet in a cell of one of four 64-bit SimHash words, whose partitions and
    flips are chosen so that two documents at the threshold meet with a chance of `sure`, and are within `radius` of all 256
    bits (at the threshold they differ in about 39, deviation 6). Whatever hangs together by such pairs is a family; within a family
    all pairs are verified on their sets of shingles, so a link that no cell sent on is tested as well. Rows of one id are told
    apart by their words. component_id is the smallest id of the group.
    """
    rows, found = grouped(only_id_text(docs).where("doc_id is not null"), width, threshold, seed, **OPTIONS | options)
    ids = found.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = looked_up(found, ids, "label").select("words", "component_id")
    return looked_up(rows, named, "words").select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8, seed: int = 42, **options) -> DataFrame:
    """One row of each similar group, that of the smallest id; rows that have no id stay.

    Of rows with the same id and the same words one stays.
    """
    _, found = grouped(only_id_text(docs).where("doc_id is not null"), width, threshold, seed, **OPTIONS | options)
    words, key, turn = (unused(docs, x) for x in ("_words", "_key", "_turn"))
    keep = found.groupBy("label").agg(F.min(F.struct("doc_id", "words")).alias("k")).select(F.col("k.doc_id").alias(key), F.col("k.words").alias(words))
    rows = with_wording(docs.where("doc_id is not null"), words).withColumn(key, F.col("doc_id").cast("long"))
    order = Window.partitionBy(key, words).orderBy(F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType)))))
    rows = rows.withColumn(turn, F.row_number().over(order)).where(F.col(turn) == 1)
    kept = rows.join(keep.hint("merge"), [key, words], "left_semi")
    return kept.select(docs.columns).unionByName(docs.where("doc_id is null"))
