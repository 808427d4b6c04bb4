"""Windows of compacted items along chains of steps (chunks, turns, pages), chains of any length.

A step either replaces the window by its own compacted items or appends them. What a window is after a step follows from two
running values of the chain: how many items there have been, and how many before the last replacing step. So a chain
isn't walked: it is a segmented scan over range partitions, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import running


def compacted() -> Column:
    return F.contains(F.lower(F.coalesce("type", F.lit(""))), F.lit("compact"))


def steps(items: DataFrame, mode: str = "chain") -> DataFrame:
    """chain, step, n_output, n_raw, own_items, own_chars, offset, window_items, window_chars, first_step, ran: a row for each step.

    items: chain, step, type, text, replaces (of the step, any of its items says so). A null type makes a row that only says that the
    step took place. mode: `chain` (a step replaces the window), `independent` (all append), `mixed` (as `replaces` says).
    own: what a step puts into the window; offset: the items before it there. A step without compacted items fails: it and all
    later ones of its chain have not run (in `independent` mode too), and leave the window as it was.
    """
    each = items.groupBy("chain", "step").agg(
        F.count("type").alias("n_output"), F.count_if(compacted()).alias("_n"), F.coalesce(F.sum(F.when(compacted(), F.length(F.coalesce("text", F.lit(""))))), F.lit(0)).alias("_c"), F.max("replaces").alias("_replaces")
    )
    replaces = {"chain": F.lit(True), "independent": F.lit(False), "mixed": F.coalesce("_replaces", F.lit(False))}[mode]
    rows = running(each, ["chain"], ["step"], {"_failed": (F.col("_n") == 0).cast("long")})
    ran = F.col("_failed") == 0
    rows = rows.withColumns({"ran": ran, "own_items": F.when(ran, F.col("_n")).otherwise(0), "own_chars": F.when(ran, F.col("_c")).otherwise(0), "_new": ran & replaces})
    rows = running(rows, ["chain"], ["step"], {"_items": F.col("own_items"), "_chars": F.col("own_chars")})
    cut_at = F.when(F.col("_new"), F.struct((F.col("_items") - F.col("own_items")).alias("items"), (F.col("_chars") - F.col("own_chars")).alias("chars"), F.col("step").alias("step")))
    rows = running(rows, ["chain"], ["step"], lasts={"_cut": cut_at})
    before = lambda c: F.coalesce(F.col(f"_cut.{c}"), F.lit(0))
    window = F.col("_items") - before("items")
    return rows.select(
        "chain", "step", "n_output", (F.col("n_output") - F.col("_n")).alias("n_raw"), "own_items", "own_chars", (window - F.col("own_items")).alias("offset"), window.alias("window_items"),
        (F.col("_chars") - before("chars")).alias("window_chars"), F.col("_cut.step").alias("first_step"), "ran",
    )


def window(items: DataFrame, made: DataFrame) -> DataFrame:
    """chain, place, step, ord, type, text: the items of each chain's last window, placed from 0. items: as in `steps`, with ord; made: steps(items)."""
    last = made.where("ran").groupBy("chain").agg(F.max_by("first_step", "step").alias("_from"))
    inside = made.where("ran").join(last, "chain").where("_from is null or step >= _from").select("chain", "step", "offset")
    own = running(items.where(compacted()).drop("replaces"), ["chain", "step"], ["ord"], {"_i": F.lit(1)})
    return own.join(inside, ["chain", "step"]).select("chain", (F.col("offset") + F.col("_i") - 1).alias("place"), "step", "ord", "type", "text")
