r"""Ranked lexical search by Fagin's threshold algorithm (operator 12).

Terms are runs of letters, digits and characters beyond ASCII, A-Z in lower case. A document's score for an item is the sum,
over the item's terms with repeats, of weight times saturated frequency, all in integers; nothing depends on the order of sums.

Index: one pass over the whole texts keeps, of each document, its length and the terms that any item holds with their
frequencies (forward index, written once; about a fifth of the text). Its sums give the number of documents and terms and the
document frequency of the items' terms; only these, as many as the items have terms, come to the driver.

Search: the forward index is read in blocks of up to `postings` entries (bounded memory, no shuffle). In a block, the
documents of each term form a list in the order of impact. For an item its lists are read round-robin, `step` places of each at a
time (doubled as it goes deeper); documents not met before are scored in full by lookups in the forward index; the threshold
is the score of a document that would stand at the place just read in every list. When it falls strictly below
the k-th best score, no document not met can be among the best, not even by a tie, and the block is done. At worst a block is
scored as a whole; that is the bound on time. The best of all blocks meet by item, in two steps, so no task gets more than k rows of
a part of the corpus.

Items are broadcast in pieces of `piece_bytes` of text (checked; at most twice that, or one item), one index and search for each.

Defined cases: a null or empty text has no terms: as a document it is not counted, as an item it has no rows; documents that
score 0 are left out; equal rows of items count once and different texts of one item_id are one item with the terms of all; a null
item_id is an id of its own; repeated rows of documents are ranked each; null doc_ids come after all others that tie;
very long texts are handled one at a time; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import only_id_text, slices, stored, texts

#: Lower-cases A-Z and turns every other ASCII character but letters and digits into a blank.
TERM = bytes(c if c >= 128 or 48 <= c < 58 or 97 <= c < 123 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(TERM).split()


def pieces(items: DataFrame, piece_bytes: int) -> Iterator[dict]:
    """The items' terms with their repeats, by item_id, in pieces of a checked size."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-total // piece_bytes)
    of = lambda n: F.pmod(F.xxhash64("item_id"), F.lit(n))
    for _ in range(8):  # the hash deals unevenly where items are few and long
        fill = rows.groupBy(of(n).alias("k")).agg(F.sum(F.octet_length("text")).alias("size"), F.count_distinct("item_id").alias("ids"))
        if n < 1 or fill.where((F.col("size") > 2 * piece_bytes) & (F.col("ids") > 1)).isEmpty():
            break
        n *= 2
    for k in range(n):
        found: dict = {}
        for r in rows.where(of(n) == k).collect():
            found.setdefault(r["item_id"], Counter()).update(terms(r["text"].encode()))
        yield {i: c for i, c in found.items() if c}


def forward(docs: DataFrame, sent) -> DataFrame:
    """doc_id, n (all terms of the text), terms (numbers of the items' terms in it) and tf (their occurrences)."""
    names = ["doc_id", "n", "terms", "tf"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value
        for b in slices(batches):
            sizes, ends, which, tf = [], [0], [], []
            for t in texts(b):
                all_of = terms(t)
                counts = Counter(all_of)
                held = counts.keys() & number.keys()
                which += map(number.__getitem__, held)
                tf += map(counts.__getitem__, held)
                sizes.append(len(all_of))
                ends.append(len(which))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (which, tf)]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), pa.array(sizes, pa.int64()), *lists], names=names)

    return only_id_text(docs).mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


class Block:
    """Impact-sorted lists and a forward index over some documents."""

    def __init__(self, batches: list[pa.RecordBatch], n_docs: int, n_terms: int):
        rows = pa.Table.from_batches(batches).combine_chunks()
        col = lambda name: rows.column(name).combine_chunks()
        ids = col("doc_id")
        self.no_id = np.array(ids.is_null())
        self.ids = np.array(ids.fill_null(0))
        self.term = np.array(col("terms").flatten(), np.int64)
        size = np.array(col("terms").value_lengths(), np.int64)
        self.ptr = np.concatenate([[0], np.cumsum(size)])
        doc = np.repeat(np.arange(len(size)), size)
        m = np.array([75 + 25 * n * n_docs // n_terms for n in col("n").to_pylist()], np.int64)
        tf = np.array(col("tf").flatten(), np.int64)
        self.impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
        order = np.lexsort((-self.impact, self.term))
        self.list_doc, self.list_impact, by = doc[order], self.impact[order], self.term[order]
        self.names, self.first = np.unique(by, return_index=True)
        self.last = np.append(self.first[1:], len(by))

    def scores(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Whole scores, looked up in the forward index."""
        size = self.ptr[docs + 1] - self.ptr[docs]
        before = np.cumsum(size) - size
        at = np.repeat(self.ptr[docs] - before, size) + np.arange(size.sum())
        return np.add.reduceat(weight[self.term[at]] * self.impact[at], before)

    def best(self, which: np.ndarray, weights: np.ndarray, weight: np.ndarray, k: int, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best documents. which, weights: an item's terms and what each adds; weight: the same by term."""
        there = np.isin(which, self.names) & (weights > 0)
        at, weights = np.searchsorted(self.names, which[there]), weights[there]
        first, last = self.first[at], self.last[at]
        met = np.zeros(len(self.ids), bool)
        top, score, depth = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while len(first):
            found = np.concatenate([self.list_doc[a + depth : min(a + depth + step, z)] for a, z in zip(first.tolist(), last.tolist(), strict=True)])
            new = np.unique(found[~met[found]])
            if len(new):
                met[new] = True
                top, score = np.append(top, new), np.append(score, self.scores(new, weight))
                order = np.lexsort((self.ids[top], self.no_id[top], -score))[:k]
                top, score = top[order], score[order]
            depth, step = depth + step, min(2 * step, 4096)
            open_ = first + depth < last
            threshold = (weights[open_] * self.list_impact[first[open_] + depth - 1]).sum()
            if not open_.any() or len(top) == k and score[-1] > threshold:
                break
            first, last, weights = first[open_], last[open_], weights[open_]
        return top, score


def blocks(batches: Iterator[pa.RecordBatch], postings: int) -> Iterator[list[pa.RecordBatch]]:
    held, size = [], 0
    for b in batches:
        n = len(b.column(b.schema.get_field_index("terms")).flatten())
        if held and size + n > postings:
            yield held
            held, size = [], 0
        held, size = [*held, b], size + n
    if held:
        yield held


def searched(index: DataFrame, sent, k: int, postings: int, step: int) -> DataFrame:
    """item_id, doc_id, score: the best documents of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, n_docs, n_terms, n_words = sent.value
        weight = np.zeros(n_words, np.int64)
        for held in blocks(batches, postings):
            block = Block(held, n_docs, n_terms)
            out: list[tuple[list, list, list]] = []
            for item_id, which, weights in items:
                weight[which] = weights
                top, score = block.best(which, weights, weight, k, step)
                weight[which] = 0
                keep = score > 0
                ids = [None if none else i for i, none in zip(block.ids[top[keep]].tolist(), block.no_id[top[keep]].tolist(), strict=True)]
                out.append(([item_id] * len(ids), ids, score[keep].tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([v for part in out for v in part[c]], pa.int64()) for c in range(3)], names=["item_id", "doc_id", "score"])

    return index.mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, postings: int = 2_000_000, step: int = 32, piece_bytes: int = 8 << 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item, those with a score above 0."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for piece in pieces(items, piece_bytes):
        number = {t: i for i, t in enumerate(sorted(set().union(*piece.values())))}
        index = stored(forward(docs, spark.sparkContext.broadcast(number)))
        n_docs, n_terms = index.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            continue
        held_by = dict(index.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        weigh = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held_by.get(number[t], 0) + 1)))  # noqa: B023, E731
        asked = [(i, np.array([number[t] for t in c], np.int64), np.array([n * weigh(t) for t, n in c.items()], np.int64)) for i, c in piece.items()]
        found = searched(index, spark.sparkContext.broadcast((asked, n_docs, n_terms, len(number))), k, postings, step)
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        part = F.pmod(F.xxhash64("doc_id"), F.lit(64))
        near = found.withColumn("_part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "_part").orderBy(*order))).where(F.col("rank") <= k)
        best = near.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
        out = out.unionByName(best.select("item_id", "rank", "doc_id", "score"))
    return out


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, ws, len(ws) AS n FROM (SELECT doc_id, {_TERMS} AS ws FROM documents) WHERE len(ws) > 0),
s AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM d),
q AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest({_TERMS}) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
p AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, n, unnest(ws) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln(any_value(2 * nd + 2) / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, s GROUP BY t),
x AS (SELECT item_id, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // l)))) AS BIGINT) AS score FROM p JOIN w USING (t) JOIN q USING (t), s GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""
