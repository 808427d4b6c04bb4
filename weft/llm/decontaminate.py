"""Benchmark decontamination with SimHash windows (operator 1).

Every benchmark item is compared with windows of its own number of words in every document:

1. A window can reach the similarity with no item at all if too few of its shingles occur anywhere in the benchmark.
   So shingles are looked up in the set of all items' shingles, and windows with fewer hits than the threshold
   implies are passed over; this asks for no item and loses nothing.
2. The windows left are fingerprinted by SimHash (`BITS` bits over their shingles, by multiplicity), from running
   sums of bits.
3. Multi-index Hamming search: fingerprints are cut into radius // 2 + 1 blocks. Whatever is within `radius` bits of an item
   agrees with it in some block but for one bit at most. For each value of a block a bitmap says which items have it, or a
   value one flip away; the bitmaps of a window's blocks, joined, are its candidates, and those within the radius
   stay. At the threshold two SimHashes differ in about 19 of 128 bits (deviation 4); the radius of 36 is four deviations
   beyond.
4. Pairs within the radius are verified exactly: weighted Jaccard similarity of their shingle multisets,
   sum of the smaller counts over sum of the larger, at least 0.8 with five-word shingles.

Items of fewer than five words are one shingle, so they match where their words stand. A document shorter
than an item is one window.

The benchmark is broadcast in pieces of about `piece_bytes` of text (checked: at most twice that, or one item), one pass over
the documents for each piece; windows are searched in runs whose size follows the number of items, so memory has a bound; documents are neither shuffled nor collected. Defined cases: null or empty texts have no windows and
items without words match nothing; repeated rows and null ids (they match under a null id) are rows like any others,
an item that is repeated word for word under its id counts once; empty tables give no rows; further columns are ignored by `leaks` and kept by
`drop_leaks`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, slices, texts

BITS = 128
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Of word hashes; equal shingles have equal hashes within one process."""
    n = len(h) - width + 1
    out = h[:n].copy()
    for k in range(1, width):
        out = (out ^ (out >> np.uint64(29))) * MIX + h[k : k + n]
    return out * MIX


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)


def shingles(words: list[bytes], width: int) -> list[bytes]:
    return [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]


def similarity(a: Counter, b: Counter) -> float:
    common = sum((a & b).values())
    return common / (a.total() + b.total() - common)


def bits_of(found: list[bytes]) -> np.ndarray:
    raw = b"".join(xxhash.xxh128_digest(s) for s in found)
    return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, BITS // 8), axis=1)


def packed(counts: np.ndarray, n: int) -> np.ndarray:
    return np.packbits(2 * counts > n, axis=-1)


class Items:
    """A piece of the benchmark, indexed."""

    def __init__(self, rows: list[tuple[int | None, bytes]], width: int, threshold: float, radius: int):
        self.radius, self.threshold = radius, threshold
        self.ids, self.length, self.width, self.bags, prints = [], [], [], [], []
        hashes: dict[int, list[np.ndarray]] = {}
        for item_id, text in rows:
            words = words_of(text)
            if not words:
                continue
            w = min(width, len(words))
            own = shingles(words, w)
            self.ids.append(item_id)
            self.length.append(len(words))
            self.width.append(w)
            self.bags.append(Counter(own))
            prints.append(packed(bits_of(own).sum(0), len(own)))
            hashes.setdefault(w, []).append(shingle_hashes(word_hashes(words), w))
        self.known = {w: np.unique(np.concatenate(h)) for w, h in hashes.items()}
        self.maybe = {}
        for w, h in self.known.items():
            self.maybe[w] = np.zeros(1 << 20, bool)
            self.maybe[w][h >> np.uint64(44)] = True
        self.sizes = sorted(set(zip(self.length, self.width, strict=True)))
        raw = np.array(prints, np.uint8).reshape(-1, BITS // 8)
        self.prints = np.ascontiguousarray(raw).view("<u8")
        edges = np.linspace(0, BITS, radius // 2 + 2).astype(int)
        self.blocks = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        self.maps = []
        for (a, z), value in zip(self.blocks, self.values(raw), strict=True):
            held = np.zeros((1 << (z - a), len(raw)), bool)
            for flip in (0, *(1 << k for k in range(z - a))):
                held[value ^ flip, np.arange(len(raw))] = True
            self.maps.append(np.packbits(held, axis=1))

    def values(self, raw: np.ndarray) -> list[np.ndarray]:
        """The value of each block of each fingerprint."""
        bits = np.unpackbits(raw, axis=1)
        return [bits[:, a:z] @ (1 << np.arange(z - a)) for a, z in self.blocks]

    def near(self, raw: np.ndarray) -> list[tuple[int, int]]:
        """(row of fingerprints, item) of all pairs within the radius, by the multi-index."""
        out = []
        step = max(1, (1 << 22) // max(len(self.prints), 1))
        for at in range(0, len(raw), step):
            some = np.ascontiguousarray(raw[at : at + step])
            maybe = np.zeros((len(some), self.maps[0].shape[1]), np.uint8)
            for value, held in zip(self.values(some), self.maps, strict=True):
                maybe |= held[value]
            q, i = np.nonzero(np.unpackbits(maybe, axis=1, count=len(self.prints)))
            apart = np.bitwise_count(some.view("<u8")[q] ^ self.prints[i]).sum(1)
            out += zip((q[apart <= self.radius] + at).tolist(), i[apart <= self.radius].tolist(), strict=True)
        return out

    def windows(self, h: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(words, shingle width, starts) of the windows with enough shingles of the benchmark."""
        hits = {}
        for w, table in self.maybe.items():
            if len(h) >= w:
                s = shingle_hashes(h, w)
                maybe = np.nonzero(table[s >> np.uint64(44)])[0]
                at = np.minimum(np.searchsorted(self.known[w], s[maybe]), len(self.known[w]) - 1)
                places = maybe[self.known[w][at] == s[maybe]]
                if len(places):
                    hits[w] = places
        asked = {}
        for length, w in self.sizes:
            if w in hits:
                size = min(length, len(h))
                n, n_item = size - w + 1, length - w + 1
                need = self.threshold / (1 + self.threshold) * (n_item + n) - 1e-9
                asked[size, w] = min(need, asked.get((size, w), need))
        for (size, w), need in asked.items():
            places, n = hits[w], size - w + 1
            if len(places) < need:
                continue
            # runs of starts near hits: a window that counts holds one
            low, high = np.maximum(places - n + 1, 0), np.minimum(places, len(h) - size)
            new = np.concatenate(([True], low[1:] > np.maximum.accumulate(high)[:-1] + 1))
            first, last = low[new], np.maximum.accumulate(high)[np.concatenate((np.nonzero(new)[0][1:] - 1, [len(high) - 1]))]
            starts = np.concatenate([np.arange(a, z + 1) for a, z in zip(first.tolist(), last.tolist(), strict=True)])
            held = np.searchsorted(places, starts + n) - np.searchsorted(places, starts)
            if len(good := starts[held >= need]):
                yield size, w, good

    def leaks(self, text: bytes) -> list[tuple[int, float, int, int, int]]:
        """(item, similarity, first word, words, windows) for each item that the text leaks, best window first in the text."""
        words = words_of(text)
        if not words:
            return []
        best: dict[int, tuple[float, int, int, int]] = {}
        for size, w, starts in self.windows(word_hashes(words)):
            n = size - w + 1
            at = 0
            while at < len(starts):
                # windows close to one another share running sums
                end = min(np.searchsorted(starts, starts[at] + 4096), at + 4096)
                some = starts[at:end]
                at, low = end, int(some[0])
                run = np.zeros((int(some[-1]) - low + n + 1, BITS), np.int32)
                np.cumsum(bits_of(shingles(words[low : int(some[-1]) + size], w)), 0, out=run[1:])
                counts = run[some - low + n] - run[some - low]
                for q, k in self.near(packed(counts, n)):
                    if self.width[k] != w or min(self.length[k], len(words)) != size:
                        continue
                    s = int(some[q])
                    sim = similarity(Counter(shingles(words[s : s + size], w)), self.bags[k])
                    if sim >= self.threshold:
                        was = best.get(k, (0.0, 0, 0, 0))
                        best[k] = (sim, s, size, was[3] + 1) if (sim, -s) > (was[0], -was[1]) else (*was[:3], was[3] + 1)
        return [(k, *v) for k, v in sorted(best.items())]


def pieces(benchmark: DataFrame, width: int, threshold: float, radius: int, piece_bytes: int) -> Iterator:
    """Broadcasts of the benchmark, each of a checked size."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-total // piece_bytes)
    of = lambda n: F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for _ in range(8):  # the hash deals unevenly where items are few and long; a repeated item stays in one piece
        fill = rows.groupBy(of(n).alias("k")).agg(F.sum(F.octet_length("text")).alias("size"), F.count_distinct("item_id", "text").alias("items"))
        if fill.where((F.col("size") > 2 * piece_bytes) & (F.col("items") > 1)).isEmpty():
            break
        n *= 2
    for k in range(n):
        part = rows.where(of(n) == k).distinct().collect()
        got = sorted(((r["item_id"], r["text"].encode()) for r in part), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        yield benchmark.sparkSession.sparkContext.broadcast((got, width, threshold, radius))


_ITEMS: dict = {}


def indexed(sent) -> Items:
    """The index of a broadcast piece, built once in each Python worker."""
    key = sent.value
    if _ITEMS.get("of") is not key:
        _ITEMS.update(of=key, items=Items(*key))
    return _ITEMS["items"]


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = 5, threshold: float = 0.8, radius: int = 36, piece_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words, windows: one row for each item that a document leaks."""
    schema = "doc_id long, item_id long, similarity double, first_word long, n_words long, windows long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for sent in pieces(benchmark, width, threshold, radius, piece_bytes):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = indexed(sent)
            for b in slices(batches):
                found = [(i, items.ids[k], *rest) for i, t in zip(b.column(0).to_pylist(), texts(b), strict=True) for k, *rest in items.leaks(t)]
                cols = list(zip(*found, strict=True)) or [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        names = ["doc_id", "item_id", "similarity", "first_word", "n_words", "windows"]
        out = out.unionAll(rows.mapInArrow(run, schema))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 5, threshold: float = 0.8, radius: int = 36, piece_bytes: int = 8 << 20) -> DataFrame:
    """The documents that leak no item."""
    for sent in pieces(benchmark, width, threshold, radius, piece_bytes):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = indexed(sent)
            for b in slices(batches):
                yield b.filter(pa.array([not items.leaks(t) for t in texts(b)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


#: SQL for the rows of leaks() at five words and 0.8: windows that hold a shingle of the item, compared shingle by shingle.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
b AS (SELECT item_id, ws, len(ws) AS n, least(5, len(ws)) AS w FROM (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM benchmark) WHERE len(ws) > 0),
g AS (SELECT item_id, n, w, sh, count(*) AS c FROM (SELECT item_id, n, w, array_to_string(ws[i:i + w - 1], ' ') AS sh FROM (SELECT *, unnest(range(1, n - w + 2)) AS i FROM b)) GROUP BY ALL),
s AS (SELECT doc_id, w, i - 1 AS pos, nd, array_to_string(ws[i:i + w - 1], ' ') AS sh FROM (SELECT doc_id, ws, len(ws) AS nd, w, unnest(range(1, len(ws) - w + 2)) AS i FROM d, (SELECT DISTINCT w FROM b))),
h AS (SELECT doc_id, item_id, pos, nd, n, s.w, s.sh, c, least(n, nd) - s.w + 1 AS m FROM s JOIN g ON g.w = s.w AND g.sh = s.sh),
x AS (SELECT DISTINCT doc_id, item_id, nd, n, w, m, unnest(range(greatest(0, pos - m + 1), least(pos, nd - least(n, nd)) + 1)) AS start FROM h),
y AS (SELECT x.doc_id, x.item_id, start, least(x.n, x.nd) AS size, x.n - x.w + 1 AS mi, x.m, h.sh, least(count(*), any_value(c)) AS common FROM x JOIN h ON h.doc_id = x.doc_id AND h.item_id = x.item_id AND h.pos >= start AND h.pos < start + x.m GROUP BY ALL),
z AS (SELECT doc_id, item_id, start, size, sum(common) / (any_value(m) + any_value(mi) - sum(common)) AS similarity FROM y GROUP BY doc_id, item_id, start, size)
SELECT doc_id, item_id, max(similarity) AS similarity, arg_min(start, (-similarity, start)) AS first_word, arg_min(size, (-similarity, start)) AS n_words, count(*) AS windows FROM z WHERE similarity >= 0.8 GROUP BY doc_id, item_id
"""
