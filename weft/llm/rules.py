"""Quality rules as weak supervision (operator 13).

Each rule looks at one property of a text and votes good, votes bad, or abstains: between its two limits, or where the text
says too little about it. No rule decides. Expectation-maximisation finds, without any label, how often each rule is right
about good and about bad texts, and the share of good texts; the posterior probability that a text is good, given all its
votes, takes the place of a filter that every rule has to pass.

Everything is built-in expressions. Counts are taken in one pass over the texts, within each row: eight-word windows are
hashed (XXH64 over the words, 64 bits), and only in a text with equal hashes their places are sorted. What is
kept of a text is a row of numbers, written once. Votes are summed to patterns (3 ** rules at most, whatever the
corpus), and a round of the estimation is one aggregation over these.

The limits are set so that a good text seldom reaches one, while a bad text is bad in one or two ways only and passes most rules.
That is what the estimation starts from (PRIOR), with the weight of `trust` texts, and it decides where there are few texts. With
many it fades, but for one bound: a rule is right about good texts in `least_right` of the cases or more. Without it rules that
fail together would count as the one kind of bad text and what only one rule sees as that rule's error: votes alone
can't tell. Rounds end when no parameter moves by `tolerance`, or after `rounds`.

Defined cases: a null text is an empty one: no words, so it fails the base rule; a text on which all rules abstain has the
share of good texts as its probability; null and repeated ids are rows like others; an empty table gives no rows; a very
long text is one row's arrays of its words (memory in proportion to it); further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import stored

#: Share of good texts; how often a rule that votes is right about good and about bad texts.
PRIOR = (0.8, 0.998, 0.3)

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: Two characters or more, an upper-case letter among them and no lower-case one.
CAPITALS = r"^(\p{Lu}[^\p{Ll}]+|[^\p{Ll}]+\p{Lu}[^\p{Ll}]*)$"

#: Rule: a quantity, the limit from which it votes bad, the limit up to which it votes good.
RULES = {
    "symbols": ("n_symbols / n_words", 0.15, 0.02),
    "marks": ("n_marks / n_words", 0.15, 0.03),
    "capitals": ("n_capitals / n_words", 0.3, 0.1),
    "echoes": ("n_echoes / n_words", 0.3, 0.1),
    "repeats": ("greatest(n_repeat_words - 24, 0) / n_words", 0.2, 0.1),
    "lines": ("n_dup_lines / greatest(n_lines, 10)", 0.3, 0.1),
    "vocabulary": ("(n_words - n_distinct) / n_words * 50 / greatest(50, least(n_words, 400))", 0.7, 0.4),
    "lengths": ("abs(word_chars / n_words - 6)", 5.0, 3.0),
}


def let(value: Column, body) -> Column:
    """body applied to a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def repeated(words: Column, width: int) -> Column:
    """The words that stand in windows found twice or more."""

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).alias("until"), F.lit(0).alias("n"))
        grow = lambda a, at: F.struct((at + width).alias("until"), (a["n"] + F.least(F.lit(width), at + width - a["until"])).alias("n"))
        return F.aggregate(places, start, grow, lambda a: a["n"])

    def in_order(hashes: Column) -> Column:
        return F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))

    def twice(rows: Column) -> Column:
        same = lambda x, i: F.get(rows, i - 1)["h"].eqNullSafe(x["h"]) | F.get(rows, i + 1)["h"].eqNullSafe(x["h"])
        return F.array_sort(F.transform(F.filter(rows, same), lambda x: x["at"]))

    def of(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(in_order(hashes), lambda rows: covered(twice(rows)))).otherwise(0)

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(width))))
    return F.when(F.size(words) > width, let(windows, of)).otherwise(0)


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 8) -> DataFrame:
    """doc_id and what the rules look at, of each whole text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    how_many = lambda xs, test: F.size(F.filter(xs, test))

    def of(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
            F.size(F.array_distinct(words)).alias("n_distinct"),
            repeated(words, width).cast("long").alias("n_repeat_words"),
            F.aggregate(words, F.struct(F.lit("").alias("w"), F.lit(0).alias("n")), lambda a, w: F.struct(w.alias("w"), (a["n"] + (a["w"] == w).cast("int")).alias("n")), lambda a: a["n"]).alias("n_echoes"),
            how_many(words, lambda w: F.regexp_like(w, F.lit(CAPITALS))).alias("n_capitals"),
            how_many(words, lambda w: ~F.regexp_like(w, F.lit(r"[\p{L}\p{N}]"))).alias("n_marks"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    by_line = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    by_word = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"), by_line.alias("l"), by_word.alias("w"))
    return rows.select("doc_id", "n_symbols", "l.*", "w.*")


def vote(rule: str) -> Column:
    """1 good, 0 bad, null for no vote."""
    value, bad, good = RULES[rule]
    enough = F.col("n_words") >= 20
    x = F.expr(f"({value})".replace("/ n_words", "/ nullif(n_words, 0)"))  # Spark may work x out for a text without words too, before it looks at `enough`
    return F.when(enough & (x >= bad), 0).when(enough & (x <= good), 1)


def chance(model: dict) -> Column:
    """The probability that a text is good, given its votes."""
    odds = F.lit(math.log(model["good"] / (1 - model["good"])))
    for rule, (right, caught) in model["rules"].items():
        says_good, says_bad = math.log(right / (1 - caught)), math.log((1 - right) / caught)
        odds = odds + F.when(F.col(rule) == 1, says_good).when(F.col(rule) == 0, says_bad).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def estimate(votes: DataFrame, trust: float = 20.0, least_right: float = 0.99, rounds: int = 60, tolerance: float = 1e-4) -> dict:
    """good: the share of good texts; rules: for each its accuracies on good and on bad texts. votes: a column for each rule."""
    patterns = stored(votes.groupBy(*RULES).agg(F.count("*").cast("double").alias("n")).coalesce(1))
    good, right, caught = PRIOR
    model = {"good": good, "rules": {r: (right, caught) for r in RULES}}
    for _ in range(rounds):
        rows = patterns.withColumn("g", F.col("n") * chance(model)).withColumn("b", F.col("n") - F.col("g"))
        sums = [F.sum("g").alias("g"), F.sum("n").alias("n")]
        for r in RULES:
            sums += [F.sum(F.when(F.col(r) == 1, F.col("g"))).alias(f"{r}_right"), F.sum(F.when(F.col(r).isNotNull(), F.col("g"))).alias(f"{r}_good")]
            sums += [F.sum(F.when(F.col(r) == 0, F.col("b"))).alias(f"{r}_caught"), F.sum(F.when(F.col(r).isNotNull(), F.col("b"))).alias(f"{r}_bad")]
        s = {k: v or 0.0 for k, v in rows.agg(*sums).first().asDict().items()}
        share = lambda part, whole, before: (s[part] + before * trust) / (s[whole] + trust)
        after = {"good": share("g", "n", good), "rules": {}}
        for r in RULES:
            after["rules"][r] = (max(least_right, share(f"{r}_right", f"{r}_good", right)), share(f"{r}_caught", f"{r}_bad", caught))
        moved = max(abs(after["good"] - model["good"]), *(abs(a - b) for r in RULES for a, b in zip(after["rules"][r], model["rules"][r], strict=True)))
        model = after
        if moved < tolerance:
            break
    return model


def judged(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, score (the probability that a text is good) and kept."""
    rows = stored(counts(docs).withColumns({r: vote(r) for r in RULES}))
    model = estimate(rows)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = rows.withColumns({"base_failed": failed, "score": chance(model)})
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def keep_good(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs whose texts are kept; a row without an id is judged by its own text like any other."""
    from ._common import unused

    name = unused(docs, "_row")
    marked = stored(docs.withColumn(name, F.monotonically_increasing_id()))
    verdict = judged(marked.select(F.col(name).alias("doc_id"), "text"), least).where("kept").select(F.col("doc_id").alias(name))
    return marked.join(verdict, name, "left_semi").drop(name)


def oracle(trust: float = 20.0, least_right: float = 0.99, rounds: int = 60, tolerance: float = 1e-4, least: float = 0.5) -> str:
    """SQL for the rows of judged(): the estimation is a recursive query over the vote patterns."""
    good, right, caught = PRIOR
    names, each = list(RULES), range(1, len(RULES) + 1)
    votes = ", ".join(f"CASE WHEN n_words >= 20 AND {v} >= {bad} THEN 0 WHEN n_words >= 20 AND {v} <= {ok} THEN 1 END AS {r}" for r, (v, bad, ok) in RULES.items())
    odds = "ln(good / (1 - good)) + " + " + ".join(f"CASE {r} WHEN 1 THEN ln(hit[{i}] / (1 - got[{i}])) WHEN 0 THEN ln((1 - hit[{i}]) / got[{i}]) ELSE 0 END" for i, r in zip(each, names, strict=True))
    some = lambda value, test: f"coalesce(sum({value}) FILTER (WHERE {test}), 0)"
    hit = ", ".join(f"greatest({least_right}, ({some('g', f'{r} = 1')} + {right * trust}) / ({some('g', f'{r} IS NOT NULL')} + {trust}))" for r in names)
    got = ", ".join(f"({some('n - g', f'{r} = 0')} + {caught * trust}) / ({some('n - g', f'{r} IS NOT NULL')} + {trust})" for r in names)
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM documents),
win AS (SELECT doc_id, i, ws[i:i + 7] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)),
twice AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1) GROUP BY doc_id),
c AS (SELECT d.doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
  length(text) - length(regexp_replace(text, '{SYMBOL}', '', 'g')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(twice.n, 0) AS n_repeat_words,
  len(list_distinct(ws)) AS n_distinct, len(list_filter(ws, lambda w: regexp_matches(w, '{CAPITALS}'))) AS n_capitals, len(list_filter(ws, lambda w: NOT regexp_matches(w, '[\p{{L}}\p{{N}}]'))) AS n_marks,
  len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_echoes FROM d LEFT JOIN twice USING (doc_id)),
v AS (SELECT *, {votes} FROM c),
pat AS (SELECT {", ".join(names)}, CAST(count(*) AS DOUBLE) AS n FROM v GROUP BY ALL),
em AS (
  SELECT 0 AS i, {good}::DOUBLE AS good, list_transform(range({len(names)}), lambda x: {right}::DOUBLE) AS hit, list_transform(range({len(names)}), lambda x: {caught}::DOUBLE) AS got, 1.0::DOUBLE AS moved
  UNION ALL
  SELECT i + 1, good2, hit2, got2, greatest(abs(good2 - good), list_max(list_transform(range(1, {len(names) + 1}), lambda j: greatest(abs(hit2[j] - hit[j]), abs(got2[j] - got[j]))))) FROM (
    SELECT i, good, hit, got, (sum(g) + {good * trust}) / (sum(n) + {trust}) AS good2, [{hit}] AS hit2, [{got}] AS got2
    FROM (SELECT *, n / (1 + exp(-({odds}))) AS g FROM em, pat WHERE moved >= {tolerance} AND i < {rounds}) GROUP BY i, good, hit, got)),
e AS (SELECT * FROM em ORDER BY i DESC LIMIT 1),
r AS (SELECT v.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, 1 / (1 + exp(-({odds}))) AS score FROM v, e)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND score >= {least} AS kept, score FROM r
"""
