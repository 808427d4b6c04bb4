"""Ranked search against scores of every document."""

import math
import random
import re
from collections import Counter

import pytest

from weft.llm import ranking

from .test_cases import SCHEMA, odd_rows

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def plain(docs: list[tuple], items: list[tuple], k: int = 20) -> list[tuple]:
    bags = [(i, Counter(words(t))) for i, t in docs]
    sizes = [c.total() for _, c in bags]
    n, total, df = sum(s > 0 for s in sizes), sum(sizes), Counter(t for _, c in bags for t in c)
    asked: dict = {}
    for i, t in dict.fromkeys(items):
        asked.setdefault(i, Counter()).update(words(t))
    out = []
    for item, q in asked.items():
        scored = []
        for (doc, bag), size in zip(bags, sizes, strict=True):
            s = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * (75 + 25 * size * n // total))) for t, c in q.items() if bag[t])
            if s > 0:
                scored.append((-s, doc is None, doc or 0))
        out += [(item, r, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scored)[:k], 1)]
    return out


def got(frame):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in frame.collect()), key=repr)


def corpus(seed: int, n: int) -> list[tuple]:
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda: " ".join(r.choice(vocabulary[: r.choice((5, 40, 300))]).upper() + r.choice(("", ".", ", the")) for _ in range(r.randrange(1, 120)))
    rows = [(i, text()) for i in range(n)]
    return rows + [(n + i, rows[i % 7][1]) for i in range(60)]


@pytest.mark.parametrize(("postings", "step", "piece_bytes"), [(2_000_000, 32, 8 << 20), (200, 1, 400), (5_000, 2, 8 << 20)])
def test_against_all_scores(spark, postings, step, piece_bytes):
    docs = corpus(3, 700)
    items = [(i, t) for i, (_, t) in enumerate(corpus(4, 15)[:15])] + [(20, docs[0][1]), (21, "nothing-like-it"), (22, "w1 w1 w1 W2"), (2, "w7")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    wanted = spark.createDataFrame(items, "item_id long, text string")
    assert got(ranking.search(frame, wanted, postings=postings, step=step, piece_bytes=piece_bytes)) == sorted(plain(docs, items), key=repr)


def test_it_stops_early(spark):
    """A block in which k documents hold rare terms isn't read to the end of the common ones' lists."""
    import numpy as np
    import pyarrow as pa

    n = 5000
    rows = [{"doc_id": i, "n": 3, "terms": [0, 1] if i < 30 else [0], "tf": [1, 2] if i < 30 else [1]} for i in range(n)]
    block = ranking.Block([pa.RecordBatch.from_pylist(rows)], n, 3 * n)
    looked, whole = [], block.scores
    block.scores = lambda docs, weight: looked.append(len(docs)) or whole(docs, weight)
    weight = np.array([1, 5000], np.int64)
    top, _ = block.best(np.array([0, 1]), weight, weight, 20, 8)
    assert top.tolist() == list(range(20)) and sum(looked) < 100


def test_odd_rows(spark):
    docs = [r[:2] for r in odd_rows()]
    items = [(1, "one One"), (1, "one One"), (2, None), (None, "no ID 漢字"), (3, ""), (4, docs[7][1]), (5, docs[3][1])]
    frame, wanted = spark.createDataFrame(odd_rows(), SCHEMA), spark.createDataFrame([(*i, 0.5, 1) for i in items], "item_id long, text string, score double, rank int")
    assert got(ranking.search(frame, wanted)) == sorted(plain(docs, items), key=repr)
    assert ranking.search(frame.limit(0), wanted).count() == 0
    assert ranking.search(frame, wanted.limit(0)).count() == 0
