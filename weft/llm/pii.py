"""Personal data by patterns and a semi-Markov conditional random field (operator 2).

Base spans come from one pattern per kind with a check each (octets, Luhn, number of digits). The model adds
spans that the patterns miss, such as a telephone number without its country code or an address written
with "at" and "dot"; it never removes a base span.

A window of tokens around each place of interest is cut into segments: an entity of up to `MAX_TOKENS` tokens or
one token outside. Each candidate segment is scored as a whole (its shape, digits, check sums, length and
the words before it), and one pass of dynamic programming over (end, length, kind) picks boundaries and
kinds together. Weights are learnt by maximum likelihood (forward-backward over the same lattice) from
sentences made by a seeded rule with both ordinary and unusual spellings, so no corpus text is needed.

All texts are searched whole. Defined cases: a null or empty text has no spans; runs of millions of digits
or of address characters are scanned once, without backtracking; repeated rows and null ids give a row each;
an empty table gives no rows; further columns are ignored by `find_spans` and kept by `mask`.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import only_id_text, slices

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 6
CONTEXT = 5

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number), leftmost and non-overlapping within each kind, ordered by start and kind."""
    found = []
    if "@" in text:
        last = 0
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in LOCAL:  # what is walked back over belongs to one address only
                start -= 1
            if start < m.start():
                found.append((start, m.end(), 0))
                last = m.end()
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((*m.span(), 1))
    for m in CARD.finditer(text):
        if m.end() - m.start() < 40 and 12 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            found.append((*m.span(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((*m.span(), 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


# ---------------------------------------------------------------- the semi-Markov model

TOKEN = re.compile(r"\S+")
EDGE = ".,;:!?\"'"
SHAPES = {
    "dashed 3-3-4": re.compile(r"[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}"),
    "area code": re.compile(r"(?:[0-9]{1,3} )?\([0-9]{2,4}\) ?[0-9]{3}[-. ]?[0-9]{3,4}"),
    "plus": re.compile(r"\+.*"),
    "quads": re.compile(r"[0-9]{4}(?:[^0-9A-Za-z][0-9]{4}){2,3}"),
    "octets": re.compile(r"[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\)| dot )[0-9]{1,3}){3}"),
    "plain number": re.compile(r"[0-9]+"),
    "at sign": re.compile(r"[^@ ]+@[^@ ]+\.[^@ ]+"),
    "spelt address": re.compile(r"[\w.%+-]+ ?(?:\[at\]|\(at\)|\{at\}|\bat\b|@) ?[\w-]+(?: ?(?:\.|\[\.\]|\[dot\]|\(dot\)|\bdot\b) ?[\w-]+)+"),
    "date": re.compile(r"[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}"),
    "number and unit": re.compile(r"[^0-9]{0,2}[0-9]+(?:[.,][0-9]+)*[^0-9]{0,2}"),
}
HINTS = ("call", "tel", "phone", "mobile", "fax", "mail", "email", "write", "contact", "ip", "host", "address", "card", "visa", "pay")
NAMES = (
    [f"shape {k}" for k in SHAPES]
    + [f"after {h}" for h in HINTS]
    + ["digits 0", "digits 1-6", "digits 7-11", "digits 12-19", "digits 20+", "luhn", "letters", "hex mix", "octets fit", "tokens 1", "tokens 2", "tokens 3+", "one shape at least", "edge space", "odd end", "bias"]
)
AT = {name: i for i, name in enumerate(NAMES)}


@lru_cache(maxsize=1 << 15)
def features(span: str, tokens: int, hint: str) -> list[int]:
    """Numbers of the features of a span of so many tokens behind a hint word (or nothing)."""
    on = [AT[f"shape {k}"] for k, p in SHAPES.items() if p.fullmatch(span)]
    if on:
        on.append(AT["one shape at least"])
    if hint:
        on.append(AT[f"after {hint}"])
    digits = NOT_DIGIT.sub("", span)
    n = len(digits)
    on.append(AT["digits 0" if not n else "digits 1-6" if n < 7 else "digits 7-11" if n < 12 else "digits 12-19" if n < 20 else "digits 20+"])
    if 12 <= n <= 19 and luhn(digits):
        on.append(AT["luhn"])
    if any(c.isalpha() for c in span):
        on.append(AT["letters"])
        if n >= 4 and "@" not in span:
            on.append(AT["hex mix"])
    parts = re.split(r"[^0-9]+", span)
    if len(parts) == 4 and all(p and len(p) <= 3 and int(p) <= 255 for p in parts):
        on.append(AT["octets fit"])
    on.append(AT["tokens 1" if tokens == 1 else "tokens 2" if tokens == 2 else "tokens 3+"])
    if not (span[-1:].isalnum() and (span[:1].isalnum() or span[:1] in "+(")):
        on.append(AT["odd end"])
    on.append(AT["bias"])
    return on


def lattice(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, int, int, list[int]]]:
    """Candidate segments (first token, end token, start, end, features); edge punctuation is left outside."""
    out = []
    for i, (start, _) in enumerate(tokens):
        before = text[slice(*tokens[i - 1])].lower().strip(EDGE) if i else ""
        hint = before if before in HINTS else ""
        for j in range(i + 1, min(i + MAX_TOKENS, len(tokens)) + 1):
            span = text[start : tokens[j - 1][1]]
            if len(span) > 120:
                break
            left = len(span) - len(span.lstrip(EDGE + "[<{"))
            body = span.strip(EDGE + "[<{").rstrip(">}]")
            if body and any(c.isdigit() or c == "@" for c in body) or " dot " in body or "at]" in body or "at)" in body:
                out.append((i, j, start + left, start + left + len(body), features(body, j - i, hint)))
    return out


def decode(n: int, segments: list, scores: np.ndarray) -> list[tuple[int, int, int]]:
    """Best segmentation of n tokens as (start, end, kind); a token outside scores 0."""
    ends: dict[int, list] = {}
    for s, row in zip(segments, scores, strict=True):
        k = int(np.argmax(row))
        if row[k] > 0:
            ends.setdefault(s[1], []).append((s[0], float(row[k]), s[2], s[3], k))
    if not ends:
        return []
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for i, score, start, end, k in ends.get(j, ()):
            if best[i] + score > best[j]:
                best[j], back[j] = best[i] + score, (i, start, end, k)
    found, j = [], n
    while j:
        if back[j] is None:
            j -= 1
        else:
            i, start, end, k = back[j]
            found.append((start, end, k))
            j = i
    return found[::-1]


def sentences(count: int, seed: int) -> list[tuple[str, set[tuple[int, int, int]]]]:
    """Sentences with the spans of the entities in them."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choices("0123456789", k=n))
    word = lambda: "".join(r.choices("aeiounrstlmdh", k=r.randint(2, 9)))

    def card() -> str:
        d = "4" + digits(14)
        return d + next(c for c in "0123456789" if luhn(d + c))

    def quads(d: str, by: str) -> str:
        return by.join(d[i : i + 4] for i in range(0, 16, 4))

    def email() -> str:
        at, dot = r.choice([("@", "."), ("@", "."), (" at ", " dot "), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "."), (" @ ", ".")])
        return f"{word()}.{digits(2)}{at}{word()}{dot}{r.choice(['com', 'org', 'example.com', 'de'])}"

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+44 {a} {b} {c}", f"1 ({a}) {b}-{c}"])

    def ip() -> str:
        p = [str(r.randint(1, 255)) for _ in range(4)]
        return r.choice([".", ".", "[.]", "(.)"]).join(p)

    def other() -> str:
        bad = digits(16)
        while luhn(bad):
            bad = digits(16)
        return r.choice([digits(r.randint(1, 6)), f"{digits(1)}.{digits(1)}", f"20{digits(2)}-0{r.randint(1, 9)}-1{digits(1)}", f"password={digits(6)}ae{digits(4)}b", "0x" + digits(4) + "f", bad, f"${digits(3)},{digits(3)}", f"{digits(2)}%", f"v{digits(1)}.{digits(1)}.{digits(1)}", f"{r.randint(256, 999)}.{digits(2)}.{digits(1)}.{digits(1)}", f"{digits(8)}-{digits(24)}", digits(9)])

    make = {0: email, 1: ip, 2: lambda: quads(card(), r.choice(["", " ", "-", "."])), 3: phone}
    out = []
    for _ in range(count):
        text, spans = "", set()
        for _ in range(r.randint(1, 3)):
            text += " ".join(word() for _ in range(r.randint(1, 4))) + " "
            k = r.choice([0, 1, 2, 3, 9, 9])
            if r.random() < 0.3:
                text += r.choice(HINTS) + r.choice([" ", ": "])
            piece = make[k]() if k < 4 else other()
            if k < 4:
                spans.add((len(text), len(text) + len(piece), k))
            text += piece + r.choice([" ", " ", ", ", ". "])
        out.append((text + word(), spans))
    return out


@lru_cache(maxsize=1)
def weights(count: int = 320, epochs: int = 60, seed: int = 5, ridge: float = 1e-3) -> np.ndarray:
    """Weights (features x kinds) by full-batch gradient ascent on the log-likelihood of the segmentations."""
    cases = []
    for text, spans in sentences(count, seed):
        tokens = [m.span() for m in TOKEN.finditer(text)]
        segments = lattice(text, tokens)
        x = np.zeros((len(segments), len(NAMES)))
        y = np.zeros((len(segments), len(KINDS)))
        for s, seg in enumerate(segments):
            x[s, seg[4]] = 1
            for k in range(len(KINDS)):
                y[s, k] = (seg[2], seg[3], k) in spans
        if segments:
            cases.append((len(tokens), [(seg[0], seg[1]) for seg in segments], x, y))
    w = np.zeros((len(NAMES), len(KINDS)))
    w[AT["bias"]] = -2
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, epochs + 1):
        grad = -ridge * w
        for n, places, x, y in cases:
            s = np.clip(x @ w, -30, 30)
            e = np.exp(s)
            mass = e.sum(1).tolist()
            a, z = [0.0] * (n + 1), [0.0] * (n + 1)
            a[0] = z[n] = 1.0
            into: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
            outof: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
            for (i, j), q in zip(places, mass, strict=True):
                into[j].append((i, q))
                outof[i].append((j, q))
            for j in range(1, n + 1):
                a[j] = a[j - 1] + sum(a[i] * q for i, q in into[j])
            for i in range(n - 1, -1, -1):
                z[i] = z[i + 1] + sum(z[j] * q for j, q in outof[i])
            around = np.array([a[i] * z[j] for i, j in places]) / a[n]
            grad += x.T @ (y - e * around[:, None]) / len(cases)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w = w + 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


PLACE = re.compile(r"[0-9@]|[\[({]at[\])}]| dot ")
CHEAP = re.compile(r"[0-9@\[({]")


def model_spans(text: str, base: list[tuple[int, int, int]], w: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans that the model finds clear of the base spans."""
    if not CHEAP.search(text) and " dot " not in text:
        return []
    found, upto, k = [], 0, 0
    taken = sorted(base)
    reach = 0
    merged = []
    for s, e, _ in taken:
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for m in PLACE.finditer(text):
        at = m.start()
        while k < len(merged) and merged[k][1] <= at:
            reach = merged[k][1]
            k += 1
        if at < upto or k < len(merged) and merged[k][0] <= at:
            continue
        stop = merged[k][0] if k < len(merged) else len(text)
        left = max(reach, upto, at - 160)
        near = [t.span() for t in TOKEN.finditer(text, left, min(stop, at + 400))]
        here = next((i for i, t in enumerate(near) if t[1] > at), 0)
        # the window runs on while its tokens keep holding digits
        end = here + 1
        quiet = 0
        while end < len(near) and quiet < CONTEXT:
            quiet = 0 if PLACE.search(text, near[end][0], near[end][1]) else quiet + 1
            end += 1
        tokens = near[max(0, here - CONTEXT) : end]
        if not tokens:
            continue
        segments = lattice(text, tokens)
        if segments:
            scores = np.array([w[s[4]].sum(0) for s in segments])
            found += decode(len(tokens), segments, scores)
        upto = tokens[-1][1]
    return found


def all_spans(text: str, w: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    base = base_spans(text)
    more = model_spans(text, base, w)
    return base, sorted(base + more, key=lambda s: (s[0], s[2]))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, a base count per kind, base_sha256 and spans of every row."""
    w = weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[list] = [[] for _ in range(6)]
            for text in b.column(1).to_pylist():
                base, every = all_spans(text or "", w)
                for k in range(4):
                    out[k].append(sum(s[2] == k for s in base))
                out[4].append(hashlib.sha256(written(base).encode()).hexdigest())
                out[5].append(written(every))
            cols = [b.column(0), *(pa.array(x, pa.int64()) for x in out[:4]), *(pa.array(x, pa.string()) for x in out[4:])]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    return only_id_text(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, last = [], 0
    for s, e, k in spans:
        if s >= last:
            out += [text[last:s], f"[{KINDS[k].upper()}]"]
        last = max(last, e)
    return "".join([*out, text[last:]])


def mask(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; n_chars, where there is one, follows."""
    w = weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            at = b.schema.get_field_index("text")
            new = [None if t is None else masked(t, all_spans(t, w)[1]) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    out = docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema.fields]))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
