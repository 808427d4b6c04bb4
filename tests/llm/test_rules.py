"""Weak supervision: counts, estimated accuracies and verdicts against plain computations."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from weft.llm import rules

from .test_cases import SCHEMA, odd_rows, prose


def plain(text: str) -> dict:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    covered = {p for i, w in enumerate(windows) if times[w] > 1 for p in range(i, i + 8)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_lines": len(lines),
        "n_repeat_words": len(covered), "n_distinct": len(set(words)), "n_echoes": sum(a == b for a, b in zip(words, words[1:])),
    }


def texts() -> list[str]:
    r = random.Random(1)
    out = [prose(i, 30 + 5 * i) for i in range(40)]
    for i in range(40):
        t = prose(100 + i, 60).split()
        kind = i % 4
        out.append(" ".join(w + r.choice("#*$%") for w in t) if kind == 0 else " ".join(t).upper() if kind == 1 else " ".join(w for w in t[:9] for _ in range(7)) if kind == 2 else "\n".join([" ".join(t[:10])] * 6 + t))
    return out + ["a b c d e f g h " * 3, "a b c d e f g h a b c d e f g h", "x " * 8, "x " * 9, "\n\n a \n a\n a ", "#" * 30]


def test_counts(spark):
    rows = [(r[0], r[1]) for r in odd_rows()] + list(enumerate(texts(), 1000))
    found = rules.counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    names = list(plain(""))
    key = lambda r: (str(r[0]), r[1:])
    assert sorted(((r["doc_id"], *[r[n] for n in names]) for r in found), key=key) == sorted(((i, *plain(t).values()) for i, t in rows), key=key)


def estimated(votes: list[tuple], trust: float, least_right: float, rounds: int) -> tuple[float, list[tuple[float, float]]]:
    good, right, caught = rules.PRIOR
    model = [(right, caught)] * len(rules.RULES)
    share = good
    for _ in range(rounds):
        chances = []
        for v in votes:
            p, q = share, 1 - share
            for x, (a, b) in zip(v, model, strict=True):
                p *= {1: a, 0: 1 - a}.get(x, 1)
                q *= {1: 1 - b, 0: b}.get(x, 1)
            chances.append(p / (p + q))
        share, old = (sum(chances) + good * trust) / (len(votes) + trust), share
        after = []
        for j in range(len(model)):
            cast = [(c, v[j]) for c, v in zip(chances, votes, strict=True) if v[j] is not None]
            a = (sum(c for c, x in cast if x == 1) + right * trust) / (sum(c for c, _ in cast) + trust)
            b = (sum(1 - c for c, x in cast if x == 0) + caught * trust) / (sum(1 - c for c, _ in cast) + trust)
            after.append((max(least_right, a), b))
        moved = max(abs(share - old), *(abs(x - y) for m, n in zip(model, after, strict=True) for x, y in zip(m, n, strict=True)))
        model = after
        if moved < 1e-4:
            break
    return share, model


def test_estimates_and_verdicts(spark):
    rows = list(enumerate(texts()))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    votes = rules.counts(frame).select("doc_id", *[rules.vote(r).alias(r) for r in rules.RULES]).orderBy("doc_id")
    model = rules.estimate(votes)
    plain_votes = [tuple(r)[1:] for r in votes.collect()]
    share, each = estimated(plain_votes, 20.0, 0.99, 60)
    assert math.isclose(model["good"], share, abs_tol=1e-9)
    for (a, b), (x, y) in zip(model["rules"].values(), each, strict=True):
        assert math.isclose(a, x, abs_tol=1e-9) and math.isclose(b, y, abs_tol=1e-9)
    kept = {r["doc_id"]: r["kept"] for r in rules.judged(frame).collect()}
    assert all(kept[i] for i in range(40)) and not any(kept[i] for i in range(40, 80))


def test_odd_rows(spark):
    odd = spark.createDataFrame(odd_rows(), SCHEMA)
    found = rules.judged(odd).collect()
    assert sorted((str(r["doc_id"]) for r in found)) == sorted(str(r[0]) for r in odd_rows())
    for r in found:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    assert rules.judged(odd.limit(0)).count() == 0
    kept = rules.keep_good(odd.withColumn("_row", F.lit(1)))
    assert kept.columns == [*odd.columns, "_row"] and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in found if r["kept"])


def test_no_python(spark):
    plan = rules.judged(spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
