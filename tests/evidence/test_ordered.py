"""Pages in order from a stream that shuffles and repeats them."""

import random
from datetime import datetime, timedelta

from weft.streaming import ordered

SCHEMA = "conversation long, page long, names array<string>, at timestamp"


def at(minutes):
    return datetime(2024, 1, 1) + timedelta(minutes=minutes)


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def pages(seed):
    r = random.Random(seed)
    return [(c, p, [r.choice("abcdefghij") for _ in range(r.randrange(5))], at(0)) for c in range(4) for p in range(6)]


def test_shuffled_and_repeated_input_gives_the_batch(spark, tmp_path):
    r = random.Random(8)
    own = pages(1)
    sent = own * 2 + [(0, None, ["x"], at(0))]
    r.shuffle(sent)
    for i in range(3):
        spark.createDataFrame(sent[i::3], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    ordered.run(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    found = rows_of(spark.read.schema(ordered.SCHEMA).parquet(f"{tmp_path}/out"))
    assert found == rows_of(ordered.of_batch(spark.createDataFrame(own, SCHEMA))) and len(found) == len(own)
    # the same files once more, from the state that is there
    spark.createDataFrame(sent, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    ordered.run(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    assert rows_of(spark.read.schema(ordered.SCHEMA).parquet(f"{tmp_path}/out")) == found


def test_a_gap_is_skipped_when_patience_ends(spark, tmp_path):
    def send(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        ordered.run(stream, f"{tmp_path}/out", f"{tmp_path}/state", patience_ms=60_000)
        return rows_of(spark.read.schema(ordered.SCHEMA).parquet(f"{tmp_path}/out"))

    assert send([(1, 0, ["a"], at(0)), (1, 3, ["a", "b"], at(1))]) == [(1, 0, 0, 1, 1)]
    found = send([(2, 0, ["z"], at(30))])  # the stream has gone on by half an hour
    assert found == [(1, 0, 0, 1, 1), (1, 3, 2, 1, 2), (2, 0, 0, 1, 1)]
    assert send([(1, 2, ["late"], at(31)), (1, 4, ["c"], at(31))]) == [(1, 0, 0, 1, 1), (1, 3, 2, 1, 2), (1, 4, 0, 1, 3), (2, 0, 0, 1, 1)]


class Store(dict):
    """A state variable that counts how often it is asked."""

    asked = 0

    def __getattribute__(self, name):
        if name in ("get", "update", "getValue", "updateValue", "containsKey", "removeKey", "keys", "values"):
            Store.asked += 1
        return super().__getattribute__(name)

    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self[key] = value

    def containsKey(self, key):
        return key in self

    def removeKey(self, key):
        del self[key]


class Value(Store):
    def get(self):
        return self["v"] if "v" in self else None

    def update(self, value):
        self["v"] = value


class Handle:
    def __init__(self):
        self.timers = []

    def getValueState(self, name, schema):
        return Value()

    def getMapState(self, name, key, schema):
        return Store()

    def listTimers(self):
        return list(self.timers)

    def deleteTimer(self, t):
        self.timers.remove(t)

    def registerTimer(self, t):
        self.timers.append(t)


class Clock:
    def getCurrentWatermarkInMs(self):
        return 0


def taken(batches, **limits):
    """Rows that a conversation's batches of (page, names) give, and how often the state was asked."""
    was = {k: getattr(ordered, k) for k in limits}
    for k, v in limits.items():
        setattr(ordered, k, v)
    p, Store.asked = ordered.InOrder(0, 1000), 0
    p.init(Handle())
    try:
        return [tuple(r[1:]) for rows in batches for r in p.handleInputRows((1,), iter([ordered.Row(page=a, names=b, at_ms=0) for a, b in rows]), Clock())], Store.asked
    finally:
        for k, v in was.items():
            setattr(ordered, k, v)


def test_state_is_asked_for_conversations_not_for_names():
    r = random.Random(3)
    own = [(p, [str(r.randrange(3000)) for _ in range(100)]) for p in range(40)]
    mixed = own * 2
    r.shuffle(mixed)
    known, want = set(), []
    for p, names in own:
        n = len(set(names) - known)
        known |= set(names)
        want.append((p, 0, n, len(known)))
    found, asked = taken([mixed])
    assert found == want and asked < 10
    assert taken([mixed[:30], mixed[30:50], mixed[50:]])[0] == want
    assert taken([mixed[:30], mixed[30:50], mixed[50:]], HELD=3, KNOWN=500)[0] == want
