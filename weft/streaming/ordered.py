"""Pages of a conversation, taken in order from a stream that delivers them late, out of order, and more than once.

A page is applied once, when all before it have been: earlier ones come out of a buffer in the state store, a page that has been
applied or is buffered already is passed over. Where a page is missing, a timer in event time is set: once the stream is `patience`
further than the first page that waits, the gap is skipped and said in the next row; a page that comes after that is too late and is
passed over. So the rows are those that a batch gives over distinct pages in order, whatever the arrival. State per conversation:
the next page, the pages that wait, the names seen.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
SCHEMA = "conversation long, page long, skipped long, n_new long, n_total long"


#: So many pages, or names, of a conversation are held outside the state store, which is asked over a socket.
HELD = 1 << 12
KNOWN = 1 << 16


class InOrder(StatefulProcessor):
    """A conversation's rows of a batch are taken in one go: its state is read once and written once, not for each name.

    Pages that come in order are applied as they are read, others held; over HELD of them go to `waiting` at once. The first KNOWN names are kept in
    blocks (`seen`), any further ones each by itself (`more`), so neither is bound to fit in a task's memory.
    """

    def __init__(self, first: int, patience_ms: int):
        self.first, self.patience_ms = first, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "page long, total long, waits boolean")
        self.waiting = handle.getMapState("waiting", "page long", "names array<string>, at_ms long")
        self.seen = handle.getMapState("seen", "page long", "names array<string>")
        self.more = handle.getMapState("more", "name string", "page long")

    def begin(self) -> None:
        was = self.at.get()
        self.page, self.total, self.waited = was if was else (self.first, 0, False)
        self.known = {n for names in self.seen.values() for n in names[0]} if self.total else set()
        self.stored = {k[0] for k in self.waiting.keys()} if self.waited else set()
        self.held, self.new, self.skipped, self.began = {}, [], 0, self.page

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self.begin()
        for row in rows:
            if row.page is None or row.page < self.page or row.page in self.held or row.page in self.stored:
                continue
            self.held[row.page] = (list(row.names or []), row.at_ms)
            if row.page == self.page:
                yield from self.applied(key)
            elif len(self.held) > HELD:
                self.put_off()
        self.end(timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.begin()
        if self.stored and min(self.stored) > self.page:
            self.skipped = min(self.stored) - self.page
            self.page += self.skipped
            yield from self.applied(key)
            self.end(timerValues)

    def applied(self, key) -> Iterator[Row]:
        while self.page in self.held or self.page in self.stored:
            if self.page in self.held:
                names = self.held.pop(self.page)[0]
            else:
                names = self.waiting.getValue((self.page,))[0]
                self.waiting.removeKey((self.page,))
                self.stored.remove(self.page)
            n_new = sum(self.adds(n) for n in dict.fromkeys(names) if n is not None)
            self.total += n_new
            yield Row(conversation=key[0], page=self.page, skipped=self.skipped, n_new=n_new, n_total=self.total)
            self.page, self.skipped = self.page + 1, 0

    def adds(self, name: str) -> bool:
        if name in self.known:
            return False
        if len(self.known) < KNOWN:
            self.known.add(name)
            self.new.append(name)
            return True
        if self.more.containsKey((name,)):
            return False
        self.more.updateValue((name,), (self.page,))
        return True

    def put_off(self) -> None:
        for page, value in self.held.items():
            self.waiting.updateValue((page,), value)
        self.stored.update(self.held)
        self.held = {}

    def end(self, timerValues) -> None:
        self.put_off()
        if self.new:
            self.seen.updateValue((self.began,), (self.new,))
        self.at.update((self.page, self.total, bool(self.stored)))
        if self.waited:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        if self.stored:
            first = min(v[1] for v in self.waiting.values())
            self.handle.registerTimer(max(first + self.patience_ms, timerValues.getCurrentWatermarkInMs() + 1))

    def close(self) -> None:
        pass


def in_order(pages: DataFrame, first: int = 0, patience_ms: int = 3_600_000, delay: str = "10 minutes") -> DataFrame:
    """conversation, page, skipped, n_new, n_total of a stream (conversation, page, names, at): names that a page adds, and how many there are after it.

    at: when a page was captured. delay: how far the stream may run back; rows that are older than that are late as a whole.

    The session needs the RocksDB state store (`STORE`).
    """
    rows = pages.withWatermark("at", delay).withColumns({"at_ms": F.unix_millis("at"), "names": F.array_distinct("names")})
    return rows.groupBy("conversation").transformWithState(InOrder(first, patience_ms), SCHEMA, "append", "eventTime")


def of_batch(pages: DataFrame, first: int = 0) -> DataFrame:
    """The same rows of a table of pages, up to the first missing one."""
    one = pages.where(F.col("page") >= first).groupBy("conversation", "page").agg(F.first("names").alias("names"))
    by = Window.partitionBy("conversation").orderBy("page")
    one = one.withColumn("_i", F.row_number().over(by)).where(F.col("page") == F.col("_i") - 1 + first)
    firsts = one.select("conversation", "page", F.explode("names").alias("name")).where("name is not null").groupBy("conversation", "name").agg(F.min("page").alias("page"))
    new = firsts.groupBy("conversation", "page").agg(F.count("*").alias("n_new"))
    out = one.select("conversation", "page").join(new, ["conversation", "page"], "left").withColumn("n_new", F.coalesce("n_new", F.lit(0)))
    return out.select("conversation", "page", F.lit(0).cast("long").alias("skipped"), "n_new", F.sum("n_new").over(by).alias("n_total"))


def run(stream: DataFrame, path: str, checkpoint: str, **options):
    """Write in_order(stream) to a Parquet table until the input that is there has been read."""
    spark: SparkSession = stream.sparkSession
    was = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        query = in_order(stream, **options).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE[0], was) if was else spark.conf.unset(STORE[0])
    query.awaitTermination()
    return query
