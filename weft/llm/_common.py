"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z and nothing else.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a temporary one, but only if all tasks run on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "weft-checkpoints"))
    return sc.getCheckpointDir()


_PLACES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def stored(df: DataFrame) -> DataFrame:
    """Write df once as a Parquet table of the shared folder and go on from there.

    Lineage ends here: what follows reads the written copy, also after an executor is lost, and only the columns it needs.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PLACES[out] = path
    return out


cut = stored


def discard(*tables: DataFrame) -> None:
    """Delete what stored() wrote for these, once nothing that is still to run reads it."""
    for t in tables:
        if path := _PLACES.pop(t, None):
            sc = t.sparkSession.sparkContext
            place = sc._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


def unused(df: DataFrame, name: str) -> str:
    """A column name like `name` that df hasn't."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def looked_up(left: DataFrame, right: DataFrame, key: str, how: str = "inner", most: int = 1 << 16) -> DataFrame:
    """left joined with right, in which `key` is unique. A key that over `most` rows of left share is dealt over as many tasks as it needs."""
    hot = stored(left.groupBy(key).agg(F.ceil(F.count("*") / most).cast("int").alias("_salts")).where("_salts > 1"))
    if hot.isEmpty():
        discard(hot)
        return left.join(right, key, how)
    dealt = left.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.coalesce("_salts", F.lit(1))).cast("int"))
    copies = right.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
    return dealt.drop("_salts").join(copies.drop("_salts"), [key, "_salt"], how).drop("_salt")


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    col = batch.column(batch.schema.get_field_index(name)).cast(pa.binary())
    return [b or b"" for b in col.to_pylist()]


def slices(batches, most: int = 8 << 20, name: str = "text"):
    """The batches in runs of rows of about `most` bytes of text, so that a task's memory has a bound."""
    for b in batches:
        col = b.column(b.schema.get_field_index(name)).cast(pa.binary())
        size = np.array(pc.fill_null(pc.binary_length(col), 0))
        edges = [0, *(np.nonzero(np.diff(np.cumsum(size) // most))[0] + 1).tolist(), b.num_rows]
        for a, z in zip(edges, edges[1:], strict=False):
            if z > a:
                yield b.slice(a, z - a)


def only_id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the two columns, so that further columns, whatever their names, play no part."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def train_side(id_col: str, mod: int, held: int):
    """crc32(id as text) mod `mod` is `held`; a row without an id is held out as well."""
    r = F.crc32(F.col(id_col).cast("string").cast("binary")) % mod
    return F.coalesce(r == held, F.lit(True))


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)
