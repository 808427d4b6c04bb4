"""The Merkle manifest against a plain computation."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from weft.llm import manifest

from .test_cases import SCHEMA, odd_rows


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes: list[str], width: int) -> tuple[str, list[list[tuple[list[str], list[str]]]]]:
    """The root, and for each node the siblings left and right of its way up."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, way in enumerate(ways):
            first = at[k] // width * width
            way.append((nodes[first : at[k]], nodes[at[k] + 1 : first + width]))
        nodes, at = [sha(*nodes[i : i + width]) for i in range(0, len(nodes), width)], [a // width for a in at]
    return nodes[0], ways


def plain(rows: list[tuple], width: int) -> list[tuple]:
    """rows: doc_id, text, lang, source, n_chars."""
    leaf = lambda r, text: sha(*map(enc, (r[0], r[3], r[2], r[4], text)))
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(groups[s], key=lambda x: x[:3])], width) for s in order}
    root, tops = climb([trees[s][0] for s in order], width)
    out = []
    for s, top in zip(order, tops, strict=True):
        for (_, _, digest, r), way in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            steps = [*way, *top]
            h = leaf(r, r[1].replace("\n", "")) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None else digest
            for left, right in steps:
                h = sha(*left, h, *right)
            out.append((r[0], digest, trees[s][0], root, sha(*[x for left, right in steps for x in (*left, *right)]), h, h == root))
    return out


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def got(frame) -> list[tuple]:
    return sorted((tuple(r[n] for n in NAMES) for r in frame.collect()), key=repr)


def test_odd_rows(spark):
    odd = spark.createDataFrame(odd_rows(), SCHEMA)
    assert got(manifest.without_line_ends(odd)) == sorted(plain([r[:5] for r in odd_rows()], 3), key=repr)
    assert manifest.without_line_ends(odd.limit(0)).count() == 0


@pytest.mark.parametrize(("width", "tier"), [(3, 1), (3, 2), (2, 3), (4, 1)])
def test_groups_of_every_size(spark, width, tier):
    rows = [(100 * s + i, f"a\n{i}" if i % 3 else None, None if i % 5 == 0 else "en", f"é{s}" if s % 2 else f"s{s}", i) for s, n in enumerate([1, 2, 3, 4, 9, 10, 28, 82]) for i in range(n)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = got(manifest.verify(frame, {"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}, even, width, tier))
    assert found == sorted(plain(rows, width), key=repr)
    assert {r[-1] for r in found} == {True, False}


def test_any_change_is_found(spark):
    rows = [(i, f"text {i}", "en", f"s{i % 3}", 6) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for column, value in (("n_chars", F.lit(7)), ("lang", F.lit(None)), ("source", F.lit("s4")), ("text", F.concat("text", F.lit(" ")))):
        found = {r["doc_id"]: r["verified"] for r in manifest.verify(frame, {column: value}, F.col("doc_id") == 11).collect()}
        assert not found.pop(11) and all(found.values()) and len(found) == 39
