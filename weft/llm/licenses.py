"""License scan by an exact set-similarity join (operator 4).

Text blocks are joined with license templates. A block is a run of as many words as the template has, wherever it
begins with one of the template's words: a notice is found in whatever way its lines are wrapped, and what else stands in
its line plays no part. A block matches if it holds at least `threshold` of the template's distinct words. The join is
exact. Template words are ordered by their document frequency over the whole corpus, rarest first; then

- prefix filter: a matching block has one of the template's first |T| - need + 1 words, need = ceil(threshold |T|), so only places
  within a block's length of such a word are looked at;
- length filter: the document has at least `need` distinct words of the template;
- positional filter: with the first common word in the order at place i, at most |T| - i words can be common;
- verification counts the distinct common words of every block left.

Templates are a list or a table (label, text) of at most `max_bytes`, so they travel with the task; documents
are neither shuffled nor collected. A match is beaten if it overlaps a match of another label that holds more of its
template (of the larger template, then of the earlier one, among equals); labels are those of matches that are not beaten. Three fixed
phrases are reported besides, wherever their words stand consecutively.

Defined cases: a null or empty text has no words; a text shorter than a template is a shorter block; words longer than any
template word are words like any others; templates without words match nothing; repeated rows and null ids give a row each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import only_id_text, slices, texts

# Words are runs of ASCII letters and digits and of everything beyond ASCII.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

# Phrases of the base scan and their labels.
PHRASES = {
    b"under the mit license": "mit",
    b"apache license version 2": "apache-2",
    b"cc by nc": "cc-by-nc",
}

# Templates and their labels.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("all-rights-reserved", "All rights reserved"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
]


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split()


def template_frequency(docs: DataFrame, templates: list[tuple[str, str]]) -> dict[bytes, int]:
    """In how many documents each template word occurs; all documents are counted."""
    vocabulary = {w for _, t in templates for w in words_of(t)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = dict.fromkeys(vocabulary, 0)
        for b in slices(batches):
            for t in texts(b):
                for w in vocabulary.intersection(t.translate(WORD_BYTES).split()):
                    counts[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    found = only_id_text(docs).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return dict.fromkeys(vocabulary, 0) | {bytes(r["word"]): r["n"] for r in found.collect()}


class Index:
    """The templates, ordered and indexed by their prefixes."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[bytes, int], threshold: float):
        order = sorted(frequency, key=lambda w: (frequency[w], w))
        self.number = {w: i for i, w in enumerate(order)}  # a word's number is its place in the order
        self.sets, self.labels, self.need, self.words = [], [], [], []
        self.prefix: list[frozenset[bytes]] = []
        for label, text in templates:
            if not (own := sorted(set(words_of(text)), key=self.number.__getitem__)):
                continue
            need = math.ceil(threshold * len(own) - 1e-9)
            self.sets.append(own)
            self.prefix.append(frozenset(own[: len(own) - need + 1]))
            self.labels.append(label)
            self.need.append(need)
            self.words.append(len(words_of(text)))
        self.vocabulary = frozenset(order)
        self.starts = frozenset().union(*self.prefix)

    def matches(self, words: list[bytes], have: frozenset[bytes]) -> list[tuple[int, int, int]]:
        """(start, template, common words) of every block that holds enough of a template, in order."""
        get = self.number.get
        ids = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
        places = np.nonzero(ids >= 0)[0]
        ids = ids[places]
        out = []
        for k, own in enumerate(self.sets):
            if self.prefix[k].isdisjoint(have) or len(common := have.intersection(own)) < self.need[k]:
                continue
            length = self.words[k]
            numbers = sorted(self.number[w] for w in common)
            rare = places[np.isin(ids, [self.number[w] for w in self.prefix[k] & have])]
            mine = np.isin(ids, numbers)
            starts = places[mine]
            # a block that counts holds a rare word at or behind its start
            following = np.searchsorted(rare, starts)
            near = following < len(rare)
            near[near] = rare[following[near]] < starts[near] + length
            starts = starts[near]
            held = np.zeros(len(starts), np.int32)
            for left, number in enumerate(numbers):
                at = places[ids == number]
                following = np.searchsorted(at, starts)
                ok = following < len(at)
                ok[ok] = at[following[ok]] < starts[ok] + length
                held += ok
                # blocks that even all words still to come don't bring far enough are done with
                alive = held + (len(numbers) - left - 1) >= self.need[k]
                starts, held = starts[alive], held[alive]
            out += zip(starts.tolist(), [k] * len(starts), held.tolist(), strict=True)
        return sorted(out)

    def unbeaten(self, found: list[tuple[int, int, int]]) -> set[str]:
        """Labels of the matches that no overlapping match of another label beats."""
        groups: dict[tuple[float, int, int], list[int]] = {}
        for start, k, held in found:
            groups.setdefault((held / len(self.sets[k]), len(self.sets[k]), -k), []).append(start)
        ranked = [(-key[2], np.array(groups[key])) for key in sorted(groups, reverse=True)]
        labels = set()
        for i, (k, starts) in enumerate(ranked):
            free = np.ones(len(starts), bool)
            for j, other in ranked[:i]:
                if self.labels[j] != self.labels[k]:
                    # the first start of the other that ends behind this one's start
                    at = np.searchsorted(other, starts - self.words[j], "right")
                    ok = at < len(other)
                    ok[ok] = other[at[ok]] < starts[ok] + self.words[k]
                    free &= ~ok
            if free.any():
                labels.add(self.labels[k])
        return labels


def positions(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of every place of a phrase."""
    joined = b" " + b" ".join(words) + b" "
    found = []
    for phrase, label in PHRASES.items():
        sought, at, word, counted = b" " + phrase + b" ", -1, 0, 0
        while (at := joined.find(sought, at + 1)) >= 0:
            word += joined.count(b" ", counted, at)
            counted = at
            found.append((word, label))
    return sorted(found)


def listed(templates: DataFrame, max_bytes: int) -> list[tuple[str, str]]:
    """The rows of a table of templates, which has to be small, in an order of their own."""
    size = templates.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("label")), F.lit(0))).first()[0]
    if size > max_bytes:
        raise ValueError(f"the templates have {size} bytes, over the {max_bytes} that tasks take along")
    return sorted((r["label"], r["text"]) for r in templates.where("label is not null and text is not null").select("label", "text").distinct().collect())


def scan(docs: DataFrame, templates: list[tuple[str, str]] | DataFrame | None = None, threshold: float = 0.8, max_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the matched blocks.

    blocks: word:template:containment of every match, comma-joined by first word and template, both from 0. score: 1 with a phrase, else
    the largest containment, else 0.
    """
    if templates is None:
        templates = TEMPLATES
    elif isinstance(templates, DataFrame):
        templates = listed(templates, max_bytes)
    index = Index(templates, template_frequency(docs, templates), threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[list] = [[] for _ in names[1:]]
            for t in texts(b):
                words = t.translate(WORD_BYTES).split()
                have = index.vocabulary.intersection(words)
                base = positions(words)
                found = [] if index.starts.isdisjoint(have) else index.matches(words, have)
                labels = {label for _, label in base} | index.unbeaten(found)
                share = lambda m: m[2] / len(index.sets[m[1]])
                best = 1.0 if base else max(map(share, found), default=0.0)
                blocks = ",".join(f"{m[0]}:{m[1]}:{share(m):.3f}" for m in found)
                row = (len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), best, blocks)
                for col, x in zip(out, row, strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names=names)

    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
    return only_id_text(docs).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks string")


def oracle() -> str:
    """SQL for the rows of scan() with the default templates and threshold."""
    quoted = lambda words: "[" + ", ".join(f"'{w.decode()}'" for w in words) + "]"
    phrases = ", ".join(f"('{label}', {quoted(p.split())})" for p, label in PHRASES.items())
    templates = []
    for k, (label, text) in enumerate(TEMPLATES):
        own = sorted(set(words_of(text)))
        templates.append(f"({k}, '{label}', {quoted(own)}, {len(words_of(text))}, {len(own)}, {math.ceil(0.8 * len(own) - 1e-9)})")
    return rf"""
WITH p(label, words) AS (VALUES {phrases}), t(k, label, words, length, size, need) AS (VALUES {", ".join(templates)}),
w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
s AS (SELECT rid, i - 1 AS place, label FROM (SELECT rid, ws, label, words, unnest(range(1, len(ws) - len(words) + 2)) AS i FROM w, p) WHERE ws[i:i + len(words) - 1] = words),
b AS (SELECT rid, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM s GROUP BY rid),
v AS (SELECT k, length, need, unnest(words) AS word FROM t),
e AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS place FROM w),
o AS (SELECT rid, place, word, k, length, need FROM e JOIN v USING (word)),
q AS (SELECT rid, k FROM o GROUP BY rid, k HAVING count(DISTINCT word) >= any_value(need)),
o2 AS (SELECT o.* FROM o JOIN q USING (rid, k)),
c AS (SELECT x.rid, x.k, x.place, count(DISTINCT y.word) AS n FROM o2 x JOIN o2 y ON y.rid = x.rid AND y.k = x.k AND y.place >= x.place AND y.place < x.place + x.length GROUP BY x.rid, x.k, x.place HAVING count(DISTINCT y.word) >= any_value(x.need)),
m AS (SELECT c.rid, c.k, c.place, n / size AS share, size, label, place + length AS stop FROM c JOIN t USING (k)),
a AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (
  SELECT rid, label FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.rid = m.rid AND o.label <> m.label AND o.place < m.stop AND o.stop > m.place AND (o.share > m.share OR o.share = m.share AND (o.size > m.size OR o.size = m.size AND o.k < m.k)))
  UNION SELECT rid, label FROM s) GROUP BY rid),
h AS (SELECT rid, max(share) AS share, string_agg(place || ':' || k || ':' || printf('%.3f', share), ',' ORDER BY place, k) AS blocks FROM m GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score, coalesce(blocks, '') AS blocks
FROM w LEFT JOIN b USING (rid) LEFT JOIN a USING (rid) LEFT JOIN h USING (rid)
"""
