"""Every corpus query against a plain computation of the same thing over the smallest tables."""

import collections
import hashlib
import math
import random
import re
import textwrap
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from weft.llm import decontaminate, licenses, lm, neighbours, packing, passages, pii, queries, quality, sharding, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def lower(text: bytes) -> bytes:
    return text.translate(simhash.LOWER)


def run(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def test_leaks(spark, documents):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    bags = {r["item_id"]: (len(w := lower(r["text"].encode()).split()), collections.Counter(zip(*(w[i:] for i in range(5)), strict=False))) for r in items}
    want = {}
    for doc_id, text in documents:
        grams = list(zip(*(lower(text).split()[i:] for i in range(5)), strict=False))
        near = set(grams)
        for item, (size, bag) in bags.items():
            if near & bag.keys():
                n = min(size - 4, len(grams))
                best = max(decontaminate.similarity(collections.Counter(grams[s : s + n]), bag) for s in range(len(grams) - n + 1))
                if best >= 0.8:
                    want[doc_id, item] = best
    assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in run(spark, "op1_decontaminate")} == pytest.approx(want)
    assert want


def plain_spans(text: str) -> dict[str, list]:
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    return {k: [m.span() for m in re.finditer(p, text) if ok(m)] for k, (p, ok) in rules.items()}


def test_spans(spark, documents):
    texts = dict(documents)
    for r in run(spark, "op2_pii_spans"):
        want = plain_spans(texts[r["doc_id"]].decode())
        assert [r[f"n_{k}"] for k in pii.KINDS] == [len(want[k]) for k in pii.KINDS]
        base = sorted((s, pii.KINDS.index(k), e) for k in want for s, e in want[k])
        written = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert {x for x in written.split(",") if x} <= set(r["spans"].split(","))


def test_spans_of_noise():
    r = random.Random(3)
    for alphabet in ("a@.1-+ (2)5", "4111 1-.+@"):
        for _ in range(4000):
            text = "".join(r.choices(alphabet, k=r.randint(0, 40)))
            want = plain_spans(text)
            found = pii.base_spans(text)
            assert {k: [s[:2] for s in found if pii.KINDS[s[2]] == k] for k in pii.KINDS} == want


def test_spans_in_linear_time():
    start = time.monotonic()
    for unit in ("@a.b ", "a@", "a.b@c", "+1 ", "1.2.3.4", "4111 "):
        pii.base_spans(unit * (2_000_000 // len(unit)))
    assert time.monotonic() - start < 60


def test_model_finds_unusual_spellings():
    w = pii.weights()
    hit = missed = extra = 0
    for text, spans in pii.sentences(200, 99):
        got = set(pii.all_spans(text, w)[1])
        hit, missed, extra = hit + len(got & spans), missed + len(spans - got), extra + len(got - spans)
    assert hit >= 0.97 * (hit + missed) and extra <= 0.03 * hit


def test_language_model(spark, documents):
    rows = {r["doc_id"]: r for r in run(spark, "op3_bloom_lm")}
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    split = {i: [*lower(t).split(), b"\n"] for i, t in documents}
    c = collections.Counter(w for i, ws in split.items() if not held(i) for w in ws)
    n, v = c.total(), len(c)
    for i, ws in split.items():
        r = rows[i]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
    out = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_chances_sum_to_one(spark):
    """P(w | v) over all words of a small corpus and the unknown one, and the same scores when the filter stays in its segments."""
    r = random.Random(8)
    names = [f"t{i}" for i in range(50)]
    texts = [" ".join(r.choices(names, weights=range(1, 51), k=r.randint(1, 60))) for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    probe = [f"{v} {w}" for v in [*names[:6], *names[44:]] for w in [*names, "unknown"]]
    asked = frame.unionAll(spark.createDataFrame([(None, p) for p in [*probe, *names[:6], *names[44:]]], frame.schema))
    exact = {"bits_each": 40, "probes": 24, "mu": 24.0}
    texts_of = {i: t for i, t in enumerate(texts)}
    c2, c1 = collections.Counter(), collections.Counter()
    for i, t in texts_of.items():
        if zlib.crc32(str(i).encode()) % 10:
            ws = [*t.split(), "\n"]
            c1.update(ws)
            c2.update(zip(["\n", *ws], ws, strict=False))
    for head in (4 << 20, 30):
        one, other = (sorted((r["n_tokens"], r["score"]) for r in lm.score(asked, head=head, base=1.02, **way, **exact).collect()) for way in ({}, {"max_bytes": 0, "segment_bytes": 4096}))
        assert np.array(one) == pytest.approx(np.array(other))
    n, v = c1.total(), len(c1)
    alone = {w: (c1[w] + 0.1) / (n + 0.1 * (v + 1)) for w in [*names, "unknown", "\n"]}
    chance = lambda x, w: (c2[x, w] + 24 * alone[w]) / (c1[x] + 24)
    total = lm.score(spark.createDataFrame([(None, p) for p in probe], frame.schema).unionAll(frame), base=1.02, **exact).where("doc_id is null")
    got = sorted(r["score"] for r in total.collect())
    want = sorted(sum(math.log10(chance(x, w)) for x, w in zip(["\n", *p.split()], [*p.split(), "\n"], strict=True)) for p in probe)
    assert got == pytest.approx(want, rel=0.01)
    for x in [*names[:6], *names[44:]]:
        assert sum(chance(x, w) for w in [*names, "unknown", "\n"]) == pytest.approx(1)


def test_licenses(spark, documents):
    rows = {r["doc_id"]: r for r in run(spark, "op4_license_join")}
    sets = [(len(ws := licenses.words_of(t)), set(ws)) for _, t in licenses.TEMPLATES]
    for i, text in documents:
        words = re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
        places = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = rows[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        want = [f"{n}:{k}:{len(s & set(words[n : n + size])) / len(s):.3f}" for n, w in enumerate(words) for k, (size, s) in enumerate(sets) if w in s and len(s & set(words[n : n + size])) >= 0.8 * len(s) - 1e-9]
        assert r["blocks"] == ",".join(want)


def test_wrapped_notices(spark):
    notice = {label: t for label, t in licenses.TEMPLATES}
    wrap = lambda t: "\n".join(" * " + x for x in textwrap.wrap(t, 40))
    rows = [(i, f"int x;\n/*\n{wrap(notice[k])}\n */\nmain()") for i, k in enumerate(("mit", "bsd", "gpl", "apache-2", "isc"))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in licenses.scan(frame).collect()} == {0: "mit", 1: "bsd", 2: "gpl", 3: "apache-2", 4: "isc"}
    own = spark.createDataFrame([("zlib", "this software is provided as is")], "label string, text string")
    again = licenses.scan(spark.createDataFrame([(0, "under the MIT License: this software\nis provided as-is")], frame.schema), own).first()
    assert (again["labels"], again["base_labels"], again["n_base"]) == ("mit,zlib", "mit", 1)


def test_licenses_in_linear_time():
    start = time.monotonic()
    words = licenses.words_of("cc by nc 4.0 licensed under ") * 200_000
    index = licenses.Index(licenses.TEMPLATES, collections.Counter(w for _, t in licenses.TEMPLATES for w in licenses.words_of(t)), 0.8)
    assert len(licenses.positions(words)) == 200_000
    assert index.unbeaten(index.matches(words, index.vocabulary.intersection(words))) == {"cc-by-nc"}
    assert time.monotonic() - start < 60


def plain_fingerprint(text: bytes) -> int:
    words = lower(text).split()
    if not words:
        return 0
    w = min(4, len(words))
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + w]), 42) for i in range(len(words) - w + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def linked(ids: list, near) -> dict:
    label = {i: i for i in ids}
    for i in sorted(ids):
        todo = [i] if label[i] == i else []
        while todo:
            x = todo.pop()
            for y in ids:
                if label[y] > i and near(x, y):
                    label[y] = i
                    todo.append(y)
    return label


def test_fingerprint_classes(spark, documents):
    prints = {i: plain_fingerprint(t) for i, t in documents}
    label = linked(list(prints), lambda x, y: (prints[x] ^ prints[y]).bit_count() <= 4)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in run(spark, "op5_simhash_classes")}
    assert found == {i: (f"{prints[i]:016x}", label[i]) for i in prints}


def test_dense_fingerprints(spark):
    """A ball of close fingerprints, which meet in few cells, and scattered ones; blocks far smaller than cells."""
    r = random.Random(1)
    centre = r.getrandbits(64)
    ball = {centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 9))) for _ in range(400)}
    every = sorted(ball | {r.getrandbits(64) for _ in range(400)} | {0, (1 << 64) - 1})
    rows = [(x - (1 << 64) if x >> 63 else x,) for x in every]
    edges = simhash.links(spark.createDataFrame(rows, "fp long"), 4, block=16)
    got = {r["node"]: r["label"] for r in simhash.components(edges).collect()}
    want = linked([x[0] for x in rows], lambda x, y: ((x ^ y) & (1 << 64) - 1).bit_count() <= 4)
    groups = lambda d: sorted(sorted(v) for v in by(d).values() if len(v) > 1)
    assert groups(got) == groups(want)


def by(labels: dict) -> dict:
    out = collections.defaultdict(list)
    for k, v in labels.items():
        out[v].append(k)
    return out


def test_thresholds_cover_the_radius():
    r = np.random.default_rng(0)
    for units in (3, 5, 7):
        costs = [sorted(r.uniform(0, 9, units + 1).tolist()) for _ in range(4)]
        cost, ts = simhash.allocate(costs, units)
        every = [t for t in np.ndindex(*[units + 1] * 4) if sum(t) == units]
        assert sum(t + 1 for t in ts) == units and cost == pytest.approx(min(sum(c[t] for c, t in zip(costs, ts_, strict=True)) for ts_ in every))


def shingle_set(text: bytes) -> frozenset:
    words = lower(text).split()
    w = min(5, len(words))
    return frozenset(tuple(words[i : i + w]) for i in range(len(words) - w + 1)) if words else frozenset([()])


def alike(x: frozenset, y: frozenset) -> bool:
    return len(x & y) >= 0.8 * len(x | y) - 1e-9


def test_similar_groups(spark, documents):
    bags = {i: shingle_set(t) for i, t in documents}
    want = linked(list(bags), lambda x, y: alike(bags[x], bags[y]))
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(frame).collect()} == want


def edited(words: list[str], share: float, r: random.Random) -> list[str]:
    return [f"x{r.randrange(10**6)}" if r.random() < share else w for w in words]


def test_dense_families(spark):
    """Near copies of a few texts, of which about half the pairs hold, cut into many small blocks."""
    r = random.Random(6)
    rows = []
    for n in (60, 120, 300):
        base = [f"w{r.randrange(500)}" for _ in range(n)]
        rows += [" ".join(edited(base, r.choice([0.005, 0.01, 0.02, 0.03]), r)) for _ in range(70)]
    r.shuffle(rows)
    docs = list(enumerate(rows))
    bags = [shingle_set(t.encode()) for _, t in docs]
    label = linked(list(range(len(docs))), lambda x, y: alike(bags[x], bags[y]))
    want = sorted(sorted(docs[i][0] for i in g) for g in by(label).values())
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = simhash.similar_groups(frame, block=32, block_bytes=20_000, pivots=2).collect()
    texts = collections.defaultdict(list)
    for r in found:
        texts[r["component_id"]].append(r["doc_id"])
    assert sorted(sorted(v) for v in texts.values()) == want
    kept = simhash.drop_near_duplicates(frame, block=32, block_bytes=20_000, pivots=2).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(v[0] for v in want)


def test_unlike_texts_of_one_id(spark):
    x, y = (" ".join(f"{c}{i}" for i in range(80)) for c in "xy")
    frame = spark.createDataFrame([(1, x), (1, y), (2, x), (2, x)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"][0]) for r in simhash.drop_near_duplicates(frame).collect()) == [(1, "x"), (1, "y")]


def test_hot_keys(spark):
    from weft.llm._common import looked_up

    left = spark.range(5000).selectExpr("id", "if(id % 3 = 0, 7, id % 50) AS k")
    right = spark.range(40).selectExpr("id AS k", "id * 2 AS v")
    for how in ("inner", "left"):
        rows = sorted((r["id"], r["k"], r["v"]) for r in looked_up(left, right, "k", how, most=100).collect())
        assert rows == sorted((r["id"], r["k"], r["v"]) for r in left.join(right, "k", how).collect())
    edges = spark.range(3000).selectExpr("id % 7 AS a", "100 + id AS b")
    assert {r["node"]: r["label"] for r in simhash.components(edges, most=64).collect()} == {**{i: i for i in range(7)}, **{100 + i: i % 7 for i in range(3000)}}


def packed_well(rows, size: int) -> None:
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    assert len(by_sequence) <= math.ceil(sum(r["length"] for r in rows) / size) * 1.01 + 1


def test_packing(spark, documents):
    rows = run(spark, "op6_pack")
    packed_well(rows, 2048)
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = collections.defaultdict(dict)
    for r in rows:
        pieces[r["doc_id"]][r["piece"]] = r
    for i, text in documents:
        ids = np.array([*own.encode(text.decode(), add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for k in range(len(pieces[i])):
            r = pieces[i][k]
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes()) and (k == 0 or r["length"] == 2048)
            at += r["length"]
        assert at == len(ids)


def test_tokens_of_noise():
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    enc = packing.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    r = random.Random(7)
    for _ in range(1500):
        text = "".join(r.choices("ab Z09'sll\n\t  .,-é漢😀 ​<|endoftext|>", k=r.randint(0, 60)))
        text = r.choice(["", "<|endoftext|>", " <|endoftext|> "]) + text + r.choice(["", "<|endoftext|>x"])
        assert enc.encode(text, allowed_special="all") == own.encode(text, add_special_tokens=False).ids


def test_crossover_keeps_every_piece():
    r = random.Random(2)
    length = [r.randint(1, 900) for _ in range(300)]
    a = packing.insert([], list(range(300)), length, 2048)
    b = packing.mutated(a, length, 2048, r)
    for bins in (a, b, packing.crossed(a, b, length, 2048, r), packing.read(packing.written(a, 300))):
        assert sorted(i for x in bins for i in x) == list(range(300)) and max(packing.fill(x, length) for x in bins) <= 2048


def test_neighbours(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, v = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    found = collections.defaultdict(dict)
    for r in run(spark, "op7_hilbert_neighbours"):
        found[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    hits = total = 0
    for q in np.nonzero(ids % 100 == 0)[0]:
        away = np.sqrt(((v - v[q]) ** 2).sum(1))
        away[q] = np.inf
        best = np.lexsort((ids, away))[:10]
        got = [found[ids[q]][k] for k in range(1, 11)]
        hits, total = hits + len({x for x, _ in got} & set(ids[best].tolist())), total + 10
        assert got == sorted(got, key=lambda x: (x[1], x[0]))
        for x, score in got:
            assert score == pytest.approx(away[np.nonzero(ids == x)[0][0]], abs=1e-12)
    assert hits >= 0.9 * total


def test_jittered_copies(spark):
    """Hundreds of near copies of a vector, closer to one another than any rough code tells: the true nearest are found."""
    r = np.random.default_rng(3)
    v = np.concatenate((r.normal(size=(3000, 16)), r.normal(size=16) + 1e-4 * r.normal(size=(400, 16)))).astype(np.float32)
    ids = np.arange(len(v))
    frame = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<float>")
    found = collections.defaultdict(set)
    for row in neighbours.nearest(frame, lambda i: i % 100 == 0).collect():
        found[row["query_id"]].add(row["vec_id"])
    hits = dense = 0
    for q in range(0, len(v), 100):
        away = np.sqrt(((v.astype(float) - v[q]) ** 2).sum(1))
        away[q] = np.inf
        same = len(found[q] & set(np.argsort(away)[:10].tolist()))
        hits, dense = hits + same, dense + (same if q >= 3000 else 0)
    assert hits >= 0.9 * 340 and dense >= 0.9 * 40


def test_mirror_images():
    """The images across the sets of planes of least distance, from among all sets, itself first."""
    unit = np.random.default_rng(5).uniform(size=(7, 9))
    every = (np.arange(1 << 9)[:, None] >> np.arange(9)) & 1
    for probes in (1, 2, 40, 512, 9999):
        got = list(neighbours.mirrored(unit, probes, 100))
        rows, points = np.concatenate([r for r, _ in got]), np.concatenate([p for _, p in got])
        for i, x in enumerate(unit):
            mine = points[rows == i]
            assert (mine[0] == x).all() and len(np.unique(mine, axis=0)) == len(mine) == min(probes, 512)
            want = np.sort(every @ (x - 0.5) ** 2)[: len(mine)]
            assert np.allclose(np.sort((np.abs(mine - x) > 1e-12) @ (x - 0.5) ** 2), want)


def test_neighbours_of_a_crowd(spark):
    """Cells that many queries look into are split by query; what is found stays the same."""
    vectors = np.random.default_rng(8).normal(size=(400, 8)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    once = lambda crowd: sorted(map(tuple, neighbours.nearest(frame, lambda i: i % 2 == 0, curves=3, crowd=crowd).collect()))
    assert once(16) == once(4096)

def test_hilbert_steps():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(np.ndindex(*[1 << bits] * dims)))
        (keys,) = neighbours.hilbert_keys(cells, bits).T
        walk = cells[np.argsort(keys)]
        assert sorted(keys.tolist()) == list(range(len(cells))) and (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_shards(spark, documents):
    rows = run(spark, "op8_interleave")
    texts = dict(documents)
    count = collections.Counter(r["shard"] for r in rows)
    assert max(count.values()) - min(count.values()) <= 1 and set(count) == set(range(8))
    for r in rows:
        t = texts[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 1, zlib.crc32(t), "rows", None)
    for s in count:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(count[s]))
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").collect()}
    shares = collections.Counter((source[r["doc_id"]], r["shard"]) for r in rows)
    for x, n in collections.Counter(source.values()).items():
        assert all(abs(shares[x, s] - n / 8) <= 2 for s in count)


def test_few_rows_are_sharded(spark):
    docs = spark.createDataFrame([(i, "x", None) for i in range(3)], "doc_id long, text string, source string")
    assert sorted((r["slot"]) for r in sharding.interleave(docs).collect()) == [0, 0, 0]


def test_quality_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.QUERIES["op9_line_crf_quality"](spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in rows) >= 0.95 * len(rows)


def test_marginals():
    """Forward-backward against the sum over all labellings."""
    r = np.random.default_rng(4)
    emit, move = r.normal(size=5), r.normal(size=(2, 2))
    mass = np.zeros(5)
    total = 0.0
    for y in np.ndindex(*[2] * 5):
        p = np.exp(sum(emit[i] * y[i] for i in range(5)) + sum(move[y[i], y[i + 1]] for i in range(4)))
        total += p
        mass += p * np.array(y)
    assert quality.marginals(emit, move) == pytest.approx(mass / total)


def test_passages(spark, documents):
    where = collections.defaultdict(set)
    split = {i: lower(t).split() for i, t in documents}
    for i, w in split.items():
        for j in range(len(w) - 49):
            where[tuple(w[j : j + 50])].add(i)
    exact = {i for ids in where.values() if len(ids) > 1 for i in ids}
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    by_id = {np.uint64(xxhash.xxh64_intdigest(b" ".join(w))).view(np.int64): w for w in split.values()}
    for r in passages.shared_passages(frame).collect():
        x, y = by_id[r["b"]][r["b_start"] : r["b_end"]], by_id[r["a"]][r["a_start"] : r["a_end"]]
        assert len(x) == r["b_end"] - r["b_start"] and len(y) == r["a_end"] - r["a_start"]
        assert max(len(x), len(y)) >= 50 and r["same"] >= 0.75 * min(len(x), len(y)) and r["same"] <= passages.agreeing(x, y)
    rows = run(spark, "op10_shared_passages")
    assert exact <= {r["doc_id"] for r in rows}
    other = passages.passages(frame.repartition(7, "text")).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, other))


def test_fuzzy_passages(spark):
    """Passages of 60 words in texts of their own, with 5, 10 and 20 % of words changed in each copy; other texts share nothing."""
    r = random.Random(12)
    word = lambda: f"w{r.randrange(3000)}"
    prose = lambda n: [word() for _ in range(n)]
    rows, want = [], {}
    for share in (0.05, 0.1, 0.2):
        for g in range(40):
            base = prose(60)
            for _ in range(2):
                want[len(rows)] = (share, g)
                rows.append(" ".join([*prose(r.randint(20, 150)), *edited(base, share / 2, r), *prose(r.randint(20, 150))]))
    clean = range(len(rows), len(rows) + 100)
    rows += [" ".join(prose(200)) for _ in clean]
    found = {x["doc_id"]: x for x in passages.passages(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    for share, least in ((0.05, 0.95), (0.1, 0.9), (0.2, 0.7)):
        group = [i for i, (s, _) in want.items() if s == share]
        assert sum(i in found and want[found[i]["partner_id"]] == want[i] for i in group) >= least * len(group)
    assert not found.keys() & set(clean)


def test_long_extension(spark):
    """A passage far longer than is fetched at first around its only seeds."""
    r = random.Random(4)
    base = [f"w{r.randrange(10**6)}" for _ in range(3000)]
    texts = [" ".join(base), " ".join(["x", *base[:2990], "y"])]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["same"] for r in passages.shared_passages(frame, window=1500, least=1).collect()} == {2990}


def test_chains_against_all_subsequences():
    r = random.Random(5)
    for _ in range(60):
        spots = sorted({(r.randint(0, 20), r.randint(0, 20)) for _ in range(r.randint(1, 7))})
        pb, pa_ = np.array([s[0] for s in spots]), np.array([s[1] for s in spots])
        found = passages.chains(pb, pa_, 3, 0.1, 100)
        assert sorted(i for c in found for i in c.tolist()) == list(range(len(spots)))
        score = lambda c: 3 * len(c) - 0.1 * ((pb[c[-1]] - pb[c[0]]) + (pa_[c[-1]] - pa_[c[0]]))
        best = max(score([i for i in range(len(spots)) if m >> i & 1]) for m in range(1, 1 << len(spots)) if rising([spots[i] for i in range(len(spots)) if m >> i & 1]))
        assert max(score(c) for c in found) == pytest.approx(best)


def rising(chain: list) -> bool:
    return all(x[0] < y[0] and x[1] < y[1] for x, y in zip(chain, chain[1:], strict=False))


def test_pipeline(spark, documents):
    """Stage by stage: decisions as plain computations make them."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for _, stage in pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], SF).cache())
        assert kept[-1].columns == docs.columns
    ids = [{r["doc_id"] for r in k.select("doc_id").collect()} for k in kept]
    good = {r["doc_id"] for r in run(spark, "op9_line_crf_quality") if r["predicted"] == 1}
    assert ids[1] == good
    bags = {i: shingle_set(t) for i, t in documents if i in good}
    assert ids[2] == {i for i, x in linked(list(bags), lambda x, y: alike(bags[x], bags[y])).items() if i == x}
    leaking = {r["doc_id"] for r in run(spark, "op1_decontaminate")}
    assert ids[3] == ids[4] == ids[2] - leaking
    assert not any(any(plain_spans(r["text"]).values()) for r in kept[4].collect())
    rows = pipeline.STAGES[-1][1](spark, kept[4], SF).collect()
    packed_well(rows, 2048)
    assert {r["doc_id"] for r in rows} == ids[4]
    assert pipeline.run(spark, SF).count() == len(rows)


def test_links_of_a_large_group_are_thinned(spark):
    """A node that many cells know has few links: the join over links made 401,682 rows for 22,996 of a table without a large group."""
    pairs = [(i, j) for i in range(300) for j in range(i, 300, 7)] + [(1000, 1000), (2000, 1999)]
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(16)
    want = {**{i: i % 7 for i in range(300)}, 1000: 1000, 1999: 1999, 2000: 1999}
    for most, few in ((1 << 20, 1), (2000, 16)):
        thin = simhash.thinned(edges, most)
        assert thin.count() <= few * 303
        assert {r["node"]: r["label"] for r in simhash.components(thin).collect()} == want
    assert {r["node"]: r["label"] for r in simhash.components(edges).collect()} == want
    assert simhash.components(edges.limit(0)).count() == 0


def test_seeds_read_texts_in_one_pass(spark):
    """Seeds come straight from the rows: no second Python process holds the texts beside; copies and short texts have no seeds of their own."""
    text = " ".join(f"w{i}" for i in range(60))
    frame = spark.createDataFrame([(1, text), (2, text.upper()), (3, "too short"), (4, None)], "doc_id long, text string").coalesce(1)
    found = passages.seeded(frame, 4, 4, 1, 16, 64, 50)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    seeds = [r for r in found.collect() if r["h"]]
    assert sum(len(r["h"]) for r in seeds) == 8 * len(passages.minimizers(text.encode(), 4, 4)[0])
    assert {r["text"][:8] for r in seeds} == {passages.texts_of(frame).where("doc_id = 1").first()["text_id"].to_bytes(8, "little", signed=True)}
