"""Document quality from a linear-chain conditional random field over lines (operator 9).

Every line is labelled good or bad from features of itself and of its neighbouring lines; the marginals of
the forward-backward pass, weighted by line length, average to the document's quality, and a logistic
curve fitted on the same training documents makes the average a probability.

Training: labels only of documents whose crc32(id as text) mod 4 is not 2, at most `max_train` of each class
(those of smallest hash, so the choice is the same at every run). The chain learns from one run of at most `max_lines`
neighbouring lines of each, which begins at a place that the document's hash picks from the whole text; the logistic curve is fitted on
the averages of whole texts, as they are scored. Lines start with their document's label; one round then relabels lines of bad documents
that the first model holds to be good, since a bad document can have good lines. Labels, language, source and id feed no feature.
Scoring reads every line of every document. Of rows that repeat a training id the smallest text counts.

Defined cases: a null or empty text is one empty line; a document without lines that carry letters still
gets a score; lines of any length are features of their bytes, computed without a copy per line; null and
repeated ids give a row each (null ids count as held out); an empty table gives no rows; without any
usable label of either class the score is 0.5; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import discard, only_id_text, slices, stored, texts, train_side

# Classes of bytes: lower, upper, digit, blank, full stop and comma, mark, other ASCII, beyond ASCII.
CLASS = np.full(256, 7, np.uint8)
CLASS[:128] = 6
CLASS[97:123] = 0
CLASS[65:91] = 1
CLASS[48:58] = 2
CLASS[[9, 11, 12, 13, 32]] = 3
CLASS[[44, 46]] = 4
CLASS[list(b"!?;:\"'()-")] = 5
N_CLASS = 8
OWN = ("letters", "upper", "digit", "stops", "marks", "symbols", "bars", "words", "word length", "full stop at end", "seen before", "length", "word again", "words distinct")
NAMES = (*OWN, *(f"previous {x}" for x in OWN[:7]), *(f"next {x}" for x in OWN[:7]), "first", "last", "bias")


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(lines x features, line lengths in bytes plus one)."""
    lines = text.split(b"\n")
    n = len(lines)
    length = np.fromiter(map(len, lines), np.int64, n)
    buf = np.frombuffer(text + b"\n", np.uint8)
    ends = np.cumsum(length + 1)
    starts = ends - length - 1
    kinds = CLASS[buf]
    sums = np.empty((n, N_CLASS), np.float64)
    for k in range(N_CLASS):
        sums[:, k] = np.add.reduceat(kinds == k, starts, dtype=np.int64)
    blank = kinds == 3
    begins = np.empty(len(buf), bool)
    begins[0] = not blank[0]
    begins[1:] = ~blank[1:] & (blank[:-1] | (buf[:-1] == 10))
    begins &= buf != 10
    words = np.add.reduceat(begins, starts, dtype=np.int64)
    sums[:, 6] -= 1  # the line's end
    bars = np.add.reduceat(buf == 124, starts, dtype=np.int64)
    size = np.maximum(length, 1)
    ink = np.maximum(length - sums[:, 3], 1)
    seen: set[bytes] = set()
    again = np.zeros(n)
    last = np.zeros(n)
    same, distinct = np.zeros(n), np.ones(n)
    for i, line in enumerate(lines):
        bare = line.strip()
        again[i] = bare in seen and len(bare) > 0
        seen.add(bare)
        last[i] = bare[-1:] in (b".", b"!", b"?")
        if (count := len(found := bare.split())) > 3:
            same[i] = (sum(map(eq, found, found[1:])) + sum(map(eq, found, found[2:]))) / count
            distinct[i] = len(set(found)) / count
    letters = sums[:, 0] + sums[:, 1] + sums[:, 7]
    own = np.column_stack(
        [
            letters / ink,
            sums[:, 1] / np.maximum(letters, 1),
            sums[:, 2] / ink,
            sums[:, 4] / np.maximum(words, 1),
            10 * sums[:, 5] / ink,
            10 * (sums[:, 6] - bars) / ink,
            10 * bars / np.maximum(words, 1),
            np.minimum(np.log1p(words), 6) / 6,
            np.minimum(ink / np.maximum(words, 1), 30) / 10,
            last,
            again,
            np.log1p(size) / 10,
            3 * same,
            distinct,
        ]
    )
    own = np.minimum(own, 5)
    out = np.zeros((n, len(NAMES)))
    out[:, : len(OWN)] = own
    k = len(OWN)
    out[1:, k : k + 7] = own[:-1, :7]
    out[:-1, k + 7 : k + 14] = own[1:, :7]
    out[0, -3] = out[-1, -2] = out[:, -1] = 1
    return out, length + 1


def marginals(emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Chance of state 1 at each line; emit: lines, in favour of state 1; move: 2 x 2 transition scores."""
    n = len(emit)
    if n == 1:
        return 1 / (1 + np.exp(-np.clip(emit, -40, 40)))
    e = np.exp(np.clip(emit, -30, 30)).tolist()
    (m00, m01), (m10, m11) = np.exp(move).tolist()
    a = [0.0] * n
    p0, p1 = 1.0, e[0]
    a[0] = p1 / (p0 + p1)
    for i in range(1, n):
        q = a[i - 1]
        p0, p1 = (1 - q) * m00 + q * m10, ((1 - q) * m01 + q * m11) * e[i]
        a[i] = p1 / (p0 + p1)
    out = [0.0] * n
    out[-1] = a[-1]
    b0 = b1 = 1.0
    for i in range(n - 2, -1, -1):
        x = e[i + 1] * b1
        c0, c1 = m00 * b0 + m01 * x, m10 * b0 + m11 * x
        s = c0 + c1
        b0, b1 = c0 / s, c1 / s
        g = a[i] * b1
        out[i] = g / (g + (1 - a[i]) * b0)
    return np.array(out)


def fit_chain(x: np.ndarray, y: np.ndarray, mask: np.ndarray, steps: int = 80, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions of greatest likelihood. x: documents x lines x features, y and mask: documents x lines."""
    docs, lines, _ = x.shape
    w, t = np.zeros(x.shape[2]), np.zeros((2, 2))
    params = np.zeros(len(w) + 4)
    m, v = np.zeros_like(params), np.zeros_like(params)
    total = mask.sum()
    pair = mask[:, 1:] * mask[:, :-1]
    seen = np.array([[(pair * (y[:, :-1] == a) * (y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])
    for step in range(1, steps + 1):
        w, t = params[:-4], params[-4:].reshape(2, 2)
        e = np.exp(np.clip(x @ w, -30, 30)) * mask + (1 - mask)
        emit = np.stack((np.ones_like(e), e), -1)
        tr = np.exp(t)
        f = np.empty((docs, lines, 2))
        b = np.ones((docs, lines, 2))
        f[:, 0] = emit[:, 0] / emit[:, 0].sum(-1, keepdims=True)
        for i in range(1, lines):
            g = (f[:, i - 1] @ tr) * emit[:, i]
            g = np.where(mask[:, i, None] > 0, g, f[:, i - 1])
            f[:, i] = g / g.sum(-1, keepdims=True)
        for i in range(lines - 2, -1, -1):
            g = (emit[:, i + 1] * b[:, i + 1]) @ tr.T
            g = np.where(mask[:, i + 1, None] > 0, g, 1.0)
            b[:, i] = g / g.sum(-1, keepdims=True)
        post = f * b
        post /= post.sum(-1, keepdims=True)
        two = f[:, :-1, :, None] * tr * (emit[:, 1:] * b[:, 1:])[:, :, None, :]
        two /= two.sum((-1, -2), keepdims=True)
        want = (two * pair[..., None, None]).sum((0, 1))
        grad = np.concatenate((np.einsum("dlf,dl->f", x, (y - post[..., 1]) * mask), (seen - want).ravel())) / total
        grad -= ridge * params
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return params[:-4], params[-4:].reshape(2, 2)


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit_curve(s: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 400) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a s + b))), a at least 0.05 so that the order of documents stays."""
    weight = weight / weight.mean()
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -40, 40)))
        g = np.array([(weight * (y - p) * s).mean() - 1e-3 * a, (weight * (y - p)).mean()])
        h = weight * p * (1 - p) + 1e-4
        hess = np.array([[(h * s * s).mean() + 1e-3, (h * s).mean()], [(h * s).mean(), h.mean()]])
        da, db = np.linalg.solve(hess, g)
        a, b = max(0.05, a + 0.5 * da), b + 0.5 * db
    return a, b


class Model:
    """Weights of a fitted chain and its curve; None weights mean that there was nothing to learn from."""

    def __init__(self, w=None, t=None, curve=(1.0, 0.0)):
        self.w, self.t, self.curve = w, t, curve

    def raw(self, text: bytes) -> float:
        x, size = line_features(text)
        return float((marginals(x @ self.w, self.t) * size).sum() / size.sum())

    def score(self, text: bytes) -> float:
        if self.w is None:
            return 0.5
        a, b = self.curve
        return float(1 / (1 + np.exp(-np.clip(a * logit(np.array(self.raw(text))) + b, -40, 40))))


def train(docs: DataFrame, labels: DataFrame, max_train: int = 1000, max_lines: int = 32) -> Model:
    """Fit on a bounded sample of the labelled documents outside the held-out quarter."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    known = known.where(F.col("y").isin(0, 1) & ~train_side("doc_id", 4, 2)).groupBy("doc_id").agg(F.max("y").alias("y"))
    known = stored(known)
    shares = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.lit(9), "doc_id")
    chosen = [known.where(F.col("y") == y).orderBy(order, "doc_id").limit(max_train) for y in (0, 1)]
    chosen = chosen[0].unionAll(chosen[1])
    rows = only_id_text(docs).join(F.broadcast(chosen), "doc_id")  # at most 2 max_train ids
    rows = stored(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = []
            for doc_id, t in zip(b.column(0).to_pylist(), texts(b), strict=True):
                f = line_features(t)[0]
                start = zlib.crc32(str(doc_id).encode()) % max(1, len(f) - max_lines + 1)
                x.append(f[start : start + max_lines].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.binary())], names=["doc_id", "y", "x"])

    got = rows.mapInArrow(run, "doc_id long, y int, x binary").collect()
    got.sort(key=lambda r: r["doc_id"])
    if len({r["y"] for r in got}) < 2:
        return Model()
    x = np.zeros((len(got), max_lines, len(NAMES)))
    y, mask = (np.zeros((len(got), max_lines)) for _ in range(2))
    for i, r in enumerate(got):
        f = np.frombuffer(r["x"], "<f4").reshape(-1, len(NAMES))
        x[i, : len(f)], y[i, : len(f)], mask[i, : len(f)] = f, r["y"], 1
    label = np.array([r["y"] for r in got])

    def held() -> np.ndarray:
        out = np.zeros_like(y)
        for i in range(len(got)):
            n = int(mask[i].sum())
            out[i, :n] = marginals(x[i, :n] @ w, t)
        return out

    w, t = fit_chain(x, y, mask)
    post = held()
    worst = post == np.where(mask > 0, post, 2).min(1, keepdims=True)
    y = np.where((label[:, None] == 0) & (post > 0.5) & ~worst, 1.0, y)
    w, t = fit_chain(x, y, mask)
    chain = Model(w, t)

    def averages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([chain.raw(v) for v in texts(b)], pa.float64())], names=["doc_id", "raw"])

    raw = {r["doc_id"]: r["raw"] for r in rows.select("doc_id", "text").mapInArrow(averages, "doc_id long, raw double").collect()}
    discard(rows, known)
    # in the curve each class weighs what it does among all labels learnt from
    weight = np.array([shares[k] / (label == k).sum() for k in (0, 1)])[label]
    return Model(w, t, fit_curve(logit(np.array([raw[r["doc_id"]] for r in got])), label.astype(float), weight))


def score(docs: DataFrame, model: Model, cut_at: float = 0.7, keep: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted; with keep, the documents' own columns and predicted instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = pa.array([model.score(t) for t in texts(b)], pa.float64())
            if keep:
                yield b.append_column("_quality_", s)
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), s], names=["doc_id", "score"])

    if keep:
        fields = [T.StructField(f.name, f.dataType) for f in docs.schema.fields]
        return docs.mapInArrow(run, T.StructType([*fields, T.StructField("_quality_", T.DoubleType())])).where(F.col("_quality_") >= cut_at).select(docs.columns)
    found = only_id_text(docs).mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", train_side("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= cut_at).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return score(docs, train(docs, labels, **options))


def keep_good(docs: DataFrame, labels: DataFrame, source: DataFrame | None = None, **options) -> DataFrame:
    """The documents of predicted quality 1; the model is trained on `source` (docs where it isn't given)."""
    return score(docs, train(docs if source is None else source, labels, **options), keep=True)
