"""State that grows page by page.

The fold "read what is there, merge the page, write it back" keeps for every key where it came first and of
every field the last value. That is an aggregation, so a stream needs no hand-written state: Spark keeps
the aggregate of each key in its state store, and a restart goes on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weft.operators.merge import ordered_upsert


def accumulated(pages: DataFrame, keys: list[str], order: str, fields: list[str]) -> DataFrame:
    """The accumulated rows after all pages; of a stream, the rows that changed (update mode)."""
    return ordered_upsert(pages, keys, order, fields)


def start(stream: DataFrame, keys: list[str], order: str, fields: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's changed rows to path/batch=N; a batch that is repeated overwrites its own folder."""

    def put(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    query = accumulated(stream, keys, order, fields).writeStream.outputMode("update").foreachBatch(put)
    return query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(written: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of each key of what start() has written."""
    rest = [c for c in written.columns if c not in (*keys, "batch")]
    last = written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("s"))
    return last.select(*keys, "s.*")


def running_keys(rows: DataFrame, step: str, keys: list[str]) -> DataFrame:
    """step, n_new, n_total: distinct keys that each step adds and how many there are after it."""
    firsts = rows.groupBy(*keys).agg(F.min(step).alias(step)).groupBy(step).agg(F.count("*").alias("n_new"))
    steps = rows.select(step).distinct().join(firsts, step, "left").fillna(0, ["n_new"])
    return steps.withColumn("n_total", F.sum("n_new").over(Window.orderBy(step).rowsBetween(Window.unboundedPreceding, 0)))


def replayed(requests: DataFrame, call: Callable[[str], str], attempts: int = 3) -> DataFrame:
    """request_id, attempt, ok, output: a model call for each row with retries; every attempt is a row.

    The callable is the only side effect; with a table of recorded answers use recorded() instead.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, prompt in zip(pdf["request_id"], pdf["prompt"], strict=True):
                for n in range(1, attempts + 1):
                    try:
                        out.append((i, n, True, call(prompt)))
                        break
                    except Exception as e:  # the log of attempts is the result
                        out.append((i, n, False, type(e).__name__))
            yield pd.DataFrame(out, columns=["request_id", "attempt", "ok", "output"])

    return requests.select("request_id", "prompt").mapInPandas(run, "request_id long, attempt int, ok boolean, output string")


def recorded(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Requests with the answer recorded for the digest of their prompt (null if none)."""
    return requests.withColumn("digest", F.sha2("prompt", 256)).join(answers.select("digest", "answer"), "digest", "left")


def with_fallback(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Chunks, and for each page without any one empty chunk that covers all its resources."""
    none = pages.join(chunks.select("page").distinct(), "page", "left_anti")
    return chunks.unionByName(none.select("page", F.lit(1).cast("long").alias("chunk"), "resource_ids", F.lit(True).alias("synthetic")), allowMissingColumns=True)
