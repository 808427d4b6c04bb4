"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns for every operator."""

import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weft.llm import decontaminate, licenses, lm, neighbours, packing, passages, pii, quality, sharding, simhash

WORDS = [a + b + c for a, b, c in itertools.product("bdfgklmn", "aeiou", "rstvz")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, part int"


def prose(start: int, count: int) -> str:
    return " ".join(WORDS[(start * 7 + i * i + 3 * i) % len(WORDS)] for i in range(count))


def odd_rows() -> list[tuple]:
    long = prose(3, 20_000)
    texts = [None, "", "  \n\t ", long, long, "one", "one", prose(1, 60), prose(1, 60) + " end", "\x00 ퟿ ü 漢字 " + "9" * 5000, "a" * 200_000]
    rows = [(i, t, "en", None if i % 3 else "s", 0 if t is None else len(t), 0.5, "k", i) for i, t in enumerate(texts)]
    return [*rows, rows[7], rows[0], (None, "no id", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, prose(1, 60), 1.0), (1, prose(1, 60), 2.0), (2, None, None), (None, "one", None), (3, "", None)], "item_id long, text string, similarity double")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (5, 0, 0), (5, 0, 0), (7, 1, 1), (None, 1, 0), (8, None, None), (900, 0, 0)], "doc_id long, quality int, toxic int")


ONE_ROW_EACH = {
    "pii": lambda d: pii.find_spans(d),
    "lm": lambda d: lm.score(d),
    "licenses": lambda d: licenses.scan(d),
    "simhash": lambda d: simhash.near_duplicates(d),
    "sharding": lambda d: sharding.interleave(d, bucket_rows=3),
}


@pytest.mark.parametrize("name", ONE_ROW_EACH)
def test_a_row_for_each_row(name, odd, empty):
    ids = sorted((r["doc_id"] for r in ONE_ROW_EACH[name](odd).collect()), key=str)
    assert ids == sorted((r[0] for r in odd_rows()), key=str)
    assert ONE_ROW_EACH[name](empty).count() == 0


def test_quality(odd, empty, labels):
    found = quality.classify(odd, labels).collect()
    assert len(found) == len(odd_rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)
    assert quality.classify(empty, labels).count() == 0
    assert {r["score"] for r in quality.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.keep_good(odd, labels).columns == odd.columns


def test_packing(odd, empty):
    found = packing.pack(odd, size=64, district=50).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in found}) == len(found)
    assert sum(r["piece"] == 0 for r in found) == len(odd_rows())
    assert packing.pack(empty).count() == 0


def test_packing_long_runs(spark):
    runs = [c * 3_000_000 for c in (" ", "\n", "a", "7", " \n")]
    rows = spark.createDataFrame([(i, f"start{t}end") for i, t in enumerate(runs)], "doc_id long, text string").repartition(5)
    found = packing.pack(rows).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in enumerate(runs):
        ids = np.array([*plain.encode(f"start{t}end", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted((r["start"], r["length"], r["ids_crc32"]) for r in found if r["doc_id"] == i)
        assert [m[0] for m in mine] == [0, *np.cumsum([m[1] for m in mine])[:-1]] and sum(m[1] for m in mine) == len(ids)
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == crc for a, n, crc in mine)


def test_decontamination(odd, empty, benchmark):
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(odd, benchmark).collect()}
    assert found == {(7, 1), (8, 1), (5, None), (6, None)}
    kept = decontaminate.drop_leaks(odd, benchmark)
    assert kept.columns == odd.columns and kept.where("doc_id in (5, 6, 7, 8)").count() == 0 and kept.count() == len(odd_rows()) - 5
    assert decontaminate.leaks(empty, benchmark).count() == 0
    assert decontaminate.leaks(odd, benchmark.limit(0)).count() == 0
    assert decontaminate.drop_leaks(odd, benchmark.limit(0)).count() == len(odd_rows())


def test_near_duplicates_dropped(odd, empty):
    kept = sorted((r["doc_id"] for r in simhash.drop_near_duplicates(odd).collect()), key=str)
    # 0, 1 and 2 have no words; 3 and 4, 5 and 6, 7 and 8 are alike; rows without an id stay
    assert kept == sorted([0, 3, 5, 7, 9, 10, None, None], key=str)
    assert simhash.drop_near_duplicates(empty).count() == 0


def test_masking(odd):
    with_mail = odd.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" to a.b@c.org")))
    assert pii.mask(with_mail).where("text like '%[EMAIL]'").count() == len(odd_rows())
    assert pii.mask(odd).columns == odd.columns


def test_passages(odd, empty):
    found = passages.passages(odd).collect()
    assert {r["doc_id"] for r in found} == {3, 4, 7, 8} and {(r["doc_id"], r["partner_id"]) for r in found} == {(3, 4), (4, 3), (7, 8), (8, 7)}
    assert passages.passages(empty).count() == 0


def test_neighbours(spark):
    rows = [(i, [1.0, float(i % 4), 0.5], "x", 1.0) for i in range(30)] + [(100, None, "x", 1.0), (101, [0.0, 0.0, 0.0], "x", 1.0), (102, [1.0, None, 2.0], "x", 1.0), (103, [float("nan"), 1.0, 1.0], "x", 1.0), (104, [1.0], "x", 1.0), (None, [1.0, 1.0, 1.0], "x", 1.0), (0, [1.0, 0.0, 0.5], "x", 1.0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string, score double")
    found = neighbours.nearest(table, lambda v: v % 10 == 0, curves=3).collect()
    assert {r["query_id"] for r in found} == {0, 10, 20}
    mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == 10)
    assert [m[1] for m in mine] == [2, 6, 14, 18, 22, 26, 1, 3, 5, 7] and mine[0][2] == 0.0
    # id 0 is there twice with equal vectors: two rows that search, each finds the other first
    twice = [r["vec_id"] for r in found if r["query_id"] == 0 and r["rank"] == 1]
    assert twice == [0, 0] and sum(r["query_id"] == 0 for r in found) == 20
    assert neighbours.nearest(table.limit(0), lambda v: v % 10 == 0).count() == 0
    few = neighbours.nearest(table.where("vec_id < 3"), lambda v: v % 10 == 5).collect() + neighbours.nearest(table.where("vec_id in (1, 2, 10)"), lambda v: v % 10 == 0).collect()
    assert [(r["query_id"], r["vec_id"]) for r in sorted(few, key=lambda r: r["rank"])] == [(10, 2), (10, 1)]
