"""Best-fit packing of token sequences by a grouping genetic algorithm (operator 6).

Documents become token ids and an end id; longer ones are cut into full sequences, the remainder first. What is shorter
than a sequence is packed:

- Pieces are dealt by hash into districts of about `district` pieces, so no task holds more.
- Each district is solved on several islands, each with its own population. A solution is a list of bins. Crossover
  injects a share of the other parent's best-filled bins whole, drops the bins that hold duplicates of their
  pieces and best-fits what was displaced, longest first; mutation empties the worst bins and a few others the
  same way. Fitness is the mean squared fill.
- After each round an island's elite migrates to its neighbour island of the same district (a shuffle of
  solutions); the best island's solution counts. An island stops at the volume bound.
- Pieces of bins that stay poorly filled are pooled across districts and packed again.

Token ids are those that the "tokenizers" library gives with its default settings for `byte_bpe_50k.json`, the special string
in a text included. They are computed with tiktoken from the rank file of the same vocabulary (`tokenizer`), which gives
the same ids seven times as fast; tests compare the two. Its regular expression gives up on runs of about a million blanks or line
ends; such a text is handed to "tokenizers" itself (`slow_tokenizer`), which takes about a second a million characters.

Defined cases: a null or empty text is the end id alone; a very long text is encoded whole in one task and cut into pieces; null and repeated ids are rows like any others (each
row is packed once); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ._common import cut, only_id_text, slices

# Fixed value: the added token of the vocabulary.
SPECIAL = {"<|endoftext|>": 50256}

_ENCODING: dict = {}
_SLOW: dict = {}


def encoding(path: str) -> tiktoken.Encoding:
    if path not in _ENCODING:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODING[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return _ENCODING[path]


def token_ids(text: str, tokenizer: str, slow_tokenizer: str) -> list[int]:
    try:
        return encoding(tokenizer).encode(text, allowed_special="all")
    except ValueError:  # a run that the pattern can't match within its stack
        if slow_tokenizer not in _SLOW:
            _SLOW[slow_tokenizer] = Tokenizer.from_file(slow_tokenizer)
        return _SLOW[slow_tokenizer].encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, size: int, end_id: int, tokenizer: str, slow_tokenizer: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[list[int | None]] = [[] for _ in names]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.array([*token_ids(text or "", tokenizer, slow_tokenizer), end_id], "<u4")
                first = len(ids) % size or size
                edges = [0, *range(first, len(ids) + 1, size)]
                for k, (a, z) in enumerate(zip(edges, edges[1:], strict=False)):
                    for col, x in zip(out, (doc_id, k, a, z - a, zlib.crc32(ids[a:z].tobytes())), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return only_id_text(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# ---------------------------------------------------------------- one island

Bins = list[list[int]]


def insert(bins: Bins, items: list[int], length: list[int], size: int) -> Bins:
    """Best fit, longest first: each piece goes to the fullest bin that still takes it."""
    room: dict[int, list[int]] = {}
    open_bits = 0
    for k, b in enumerate(bins):
        left = size - sum([length[i] for i in b])
        if left:
            room.setdefault(left, []).append(k)
            open_bits |= 1 << left
    for i in sorted(items, key=lambda i: -length[i]):
        need = length[i]
        fits = open_bits >> need
        if fits:
            left = need + (fits & -fits).bit_length() - 1
            k = room[left].pop()
            if not room[left]:
                open_bits ^= 1 << left
            bins[k].append(i)
            left -= need
        else:
            k, left = len(bins), size - need
            bins.append([i])
        if left:
            if not open_bits >> left & 1:
                room[left] = []
                open_bits |= 1 << left
            room[left].append(k)
    return bins


def fill(b: list[int], length: list[int]) -> int:
    return sum([length[i] for i in b])


def fitness(bins: Bins, length: list[int], size: int) -> float:
    return sum((fill(b, length) / size) ** 2 for b in bins) / max(len(bins), 1)


def crossed(a: Bins, b: Bins, length: list[int], size: int, r: random.Random) -> Bins:
    """A child: some of b's best-filled bins whole, a's bins that share no piece with them, and the rest by best fit."""
    ranked = sorted(b, key=lambda x: -fill(x, length))
    best = ranked[: max(1, len(ranked) * 3 // 4)]
    given = [list(x) for x in best if r.random() < 0.4] or [list(best[0])]
    taken = {i for x in given for i in x}
    kept, displaced = [], []
    for x in a:
        if taken.isdisjoint(x):
            kept.append(list(x))
        else:
            displaced += [i for i in x if i not in taken]
    return insert(given + kept, displaced, length, size)


def mutated(bins: Bins, length: list[int], size: int, r: random.Random) -> Bins:
    """The worst bins and a few others emptied and their pieces inserted anew."""
    ranked = sorted(bins, key=lambda x: fill(x, length))
    worst = max(1, len(ranked) // 50)
    out = set(range(worst)) | {r.randrange(len(ranked)) for _ in range(worst * 2)}
    loose = [i for k in out for i in ranked[k]]
    r.shuffle(loose)
    loose.sort(key=lambda i: -(length[i] + r.randrange(-8, 9)))
    return insert([list(b) for k, b in enumerate(ranked) if k not in out], loose, length, size)


def evolve(length: list[int], size: int, seeds: list[Bins], seed: int, population: int, generations: int) -> Bins:
    """The best solution that an island finds from the given ones."""
    r = random.Random(seed)
    bound = -(-sum(length) // size)
    people = [list(map(list, s)) for s in seeds]
    if not people:
        people.append(insert([], list(range(len(length))), length, size))
    while len(people) < population and min(map(len, people)) > bound:
        people.append(mutated(people[0], length, size, r))
    scored = sorted(((len(p), -fitness(p, length, size), k, p) for k, p in enumerate(people)), key=lambda x: x[:3])
    for step in range(generations):
        if scored[0][0] <= bound or len(scored) < 2:
            break
        i, j = sorted(r.sample(range(len(scored)), 2))
        child = crossed(scored[i][3], scored[j][3], length, size, r)
        if r.random() < 0.5:
            child = mutated(child, length, size, r)
        scored[-1] = (len(child), -fitness(child, length, size), population + step, child)
        scored.sort(key=lambda x: x[:3])
    return scored[0][3]


def written(bins: Bins, n: int) -> bytes:
    of = np.zeros(n, "<i4")
    for k, b in enumerate(bins):
        of[b] = k
    return of.tobytes()


def read(raw: bytes) -> Bins:
    of = np.frombuffer(raw, "<i4")
    bins: Bins = [[] for _ in range(int(of.max(initial=-1)) + 1)]
    for i, k in enumerate(of.tolist()):
        bins[k].append(i)
    return [b for b in bins if b]


# ---------------------------------------------------------------- districts


def packed(items: DataFrame, size: int, district: int, islands: int, rounds: int, population: int, generations: int, seed: int) -> DataFrame:
    """uid, district, bin, offset, fill for items (uid, length)."""
    n = max(1, -(-items.count() // district))
    dealt = items.select("uid", "length", F.pmod(F.xxhash64(F.lit(seed), "uid"), F.lit(n)).alias("district"))
    isles = dealt.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)])))
    schema = "district long, island int, bins int, unfit double, solution binary"

    def turn(step: int):
        def run(key, own: pd.DataFrame, elites: pd.DataFrame) -> pd.DataFrame:
            if own.empty:
                return pd.DataFrame({"district": [], "island": [], "bins": [], "unfit": [], "solution": []})
            length = own.sort_values("uid")["length"].tolist()
            seeds = [read(x) for x in elites.sort_values(["bins", "unfit"])["solution"]]
            best = evolve(length, size, seeds, hash((seed, step, *map(int, key))), population, generations)
            return pd.DataFrame({"district": [key[0]], "island": [key[1]], "bins": [len(best)], "unfit": [-fitness(best, length, size)], "solution": [written(best, len(length))]})

        return run

    elites = items.sparkSession.createDataFrame([], schema)
    for step in range(rounds):
        arriving = elites.unionAll(elites.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)))) if step else elites
        by = arriving.groupBy("district", "island")
        elites = cut(isles.groupBy("district", "island").cogroup(by).applyInPandas(turn(step), schema))

    best = elites.groupBy("district").agg(F.min_by("solution", F.struct("bins", "unfit", "island")).alias("solution"))

    def place(key, own: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("uid", ignore_index=True)
        own["bin"] = np.frombuffer(chosen["solution"].iloc[0], "<i4").astype("int64") if len(own) else 0
        by = own.groupby("bin")["length"]
        own["offset"] = by.cumsum() - own["length"]
        own["fill"] = by.transform("sum")
        return own[["uid", "district", "bin", "offset", "fill"]]

    out = dealt.groupBy("district").cogroup(best.groupBy("district"))
    return out.applyInPandas(place, "uid long, district long, bin long, offset long, fill long")


def pack(
    docs: DataFrame, size: int = 2048, end_id: int = 0, tokenizer: str | None = None, slow_tokenizer: str | None = None, district: int = 4096, islands: int = 2, rounds: int = 2,
    population: int = 4, generations: int = 12, well_filled: float = 0.98, seed: int = 3,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    found = pieces(docs, size, end_id, tokenizer or public_tokenizers.path("byte_bpe_50k.tiktoken"), slow_tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    found = cut(found.withColumn("uid", F.monotonically_increasing_id()))
    rest = found.where(F.col("length") < size).select("uid", "length")
    options = {"size": size, "islands": islands, "rounds": rounds, "population": population, "generations": generations}
    first = cut(packed(rest, district=district, seed=seed, **options))
    good = F.col("fill") >= well_filled * size
    again = packed(rest.join(first.where(~good), "uid").select("uid", "length"), district=district, seed=seed + 1, **options)
    place = lambda df, level: df.select("uid", (F.lit(level << 60) + F.col("district") * (1 << 24) + F.col("bin")).alias("sequence_id"), "offset")
    alone = found.where(F.col("length") == size).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    placed = place(first.where(good), 0).unionAll(place(again, 1)).unionAll(alone)
    return found.join(placed, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
