"""Proportional stratified interleaving (operator 8).

Rows of each source are shuffled by a seeded hash and ranked; sorting all rows by their fractional
rank (rank - 1/2) / (rows of the source) spreads every source evenly over the whole order, so any
contiguous cut of it has the mixture of the corpus. The order is cut into shards of equal row count.

Neither rank is taken in one task: the shuffle hash, then the fractional rank, is split into equal
intervals of about `bucket_rows` rows, rows are ranked inside their interval, and the counts of the
earlier intervals are added. A source that holds a third of all rows has a third of the intervals.

Defined cases: a null source is a stratum of its own; a null text has no bytes (size 1, CRC 0); null
and repeated ids are rows like any others; an empty table gives no rows; further columns are ignored.
Rows that tie in the hash are ordered by id, CRC and size, so what is left to chance is identical.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut


def interleave(docs: DataFrame, n_shards: int = 8, seed: int = 17, bucket_rows: int = 20_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; `rows` law: shard counts differ by one at most."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source").cast("string"))).alias("stratum"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
    )
    rows = cut(rows)
    total = rows.count()
    intervals = max(1, -(-total // bucket_rows))

    shuffled = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size"))
    shuffled = shuffled.withColumn("part", F.expr(f"(shiftrightunsigned(h, 32) * {intervals}L) div {1 << 32}L"))
    by_part = Window.partitionBy("stratum", "part").orderBy("h", "doc_id", "text_crc32", "size")
    ranked = shuffled.withColumn("r", F.row_number().over(by_part))
    earlier = Window.partitionBy("stratum").orderBy("part")
    counts = shuffled.groupBy("stratum", "part").agg(F.count("*").alias("n"))
    counts = counts.select(
        "stratum",
        "part",
        (F.sum("n").over(earlier) - F.col("n")).alias("before"),
        F.sum("n").over(Window.partitionBy("stratum")).alias("n_stratum"),
    )
    fraction = (F.col("before") + F.col("r") - 0.5) / F.col("n_stratum")
    spread = ranked.join(counts, ["stratum", "part"]).withColumn("at", fraction)
    spread = cut(
        spread.select("doc_id", "size", "text_crc32", "stratum", "at", F.floor(F.col("at") * intervals).alias("interval"))
    )

    within = Window.partitionBy("interval").orderBy("at", "stratum")
    ordered = spread.withColumn("r", F.row_number().over(within))
    firsts = spread.groupBy("interval").agg(F.count("*").alias("n"))
    firsts = firsts.select("interval", (F.sum("n").over(Window.orderBy("interval")) - F.col("n")).alias("before"))
    placed = ordered.join(firsts, "interval").withColumn("pos", F.col("before") + F.col("r") - 1)
    n = max(total, 1)
    placed = placed.withColumn("shard", F.expr(f"(pos * {n_shards}) div {n}").cast("int"))
    first = F.expr(f"(shard * {n}L + {n_shards - 1}) div {n_shards}")
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("pos") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
