"""Shared pieces: session preparation, shared scratch tables, word splitting, bounded memo."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SALTS = 32
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package where it is not installed (local mode, shared disk), and bounds what they get at once."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *(p for p in paths if p)])
    # whole texts go to the workers: the default of ten thousand rows or 64 MB at once is held several times over by each task
    if spark.conf.get(_BATCH, "67108864b") == "67108864b":
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder that the cluster names in spark.checkpoint.dir.

    Where that setting is absent, one machine alone (tests) gets a local folder; a cluster's executors could not share one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(folder)
    for folders in getattr(_collecting, "lists", ()):
        folders.append(folder)
    return folder


#: Folders that this driver has handed out and not cleared.
_made: list[str] = []
_collecting = threading.local()


@contextlib.contextmanager
def collected() -> Iterator[list[str]]:
    """The folders that scratch() hands out to this thread meanwhile, and to no other."""
    folders: list[str] = []
    _collecting.lists = [*getattr(_collecting, "lists", ()), folders]
    try:
        yield folders
    finally:
        _collecting.lists = _collecting.lists[:-1]


def delete(spark: SparkSession, folders: list[str]) -> None:
    """Deletes folders of the shared folder. Results that read them are gone then."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in folders:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def made() -> int:
    """How many folders have been handed out."""
    return len(_made)


def clear(spark: SparkSession, first: int = 0, end: int | None = None) -> None:
    """Deletes what cut() and scratch() left in the shared folder, all or from one made() to another. Results that read it are gone then."""
    delete(spark, _made[first:end])


_kept: dict[str, Callable[[], None]] = {}
_owner: list[str | None] = [None]


def keeps(name: str, drop: Callable[[], None]) -> None:
    """Says how to drop what an operator keeps in a worker from task to task."""
    _kept[name] = drop


def own(name: str) -> None:
    """Called where an operator's code begins in a worker: what other operators keep there goes."""
    if _owner[0] != name:
        _owner[0] = name
        for other, drop in _kept.items():
            if other != name:
                drop()
        release()


def release() -> None:
    """Gives freed memory back to the machine, as workers live on and share their executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that owns its worker and releases memory at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own(name)
        yield from function(batches)
        release()

    return run


def cut(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, and a lost executor costs nothing."""
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def whole(df: DataFrame) -> DataFrame:
    """Each row as the one column `row`, so that columns made beside it cannot clash with its own; select("row.*") gives it back."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))


def documents(df: DataFrame) -> DataFrame:
    """doc_id and text alone, so that other columns cannot clash with derived ones; null text stays null."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


_ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(),
    "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()),
    "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary()), "array<double>": pa.list_(pa.float64()),
}


def pa_schema(schema: str) -> pa.Schema:
    """Arrow schema of a DDL string that uses the types above."""
    return pa.schema([(name, _ARROW[kind]) for name, kind in (part.split() for part in schema.split(", "))])


def as_batch(columns: dict[str, list], target: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(columns[f.name], type=f.type) for f in target], schema=target)


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ as UTF-8: bytes.split() parts at exactly these six bytes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class Memo(dict):
    """Remembers a function's values; emptied when it holds `most` entries, so that memory stays bounded."""

    def __init__(self, function: Callable, most: int = 300_000):
        super().__init__()
        self.function, self.most = function, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.function(key)
        return value


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate, which for file sources is the files' size."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def parts_for(df: DataFrame, bytes_each: int, most: int = 20_000) -> int:
    """A number of partitions that grows with the input, up to what one shuffle can well have; beyond it partitions grow and sorts spill. Spark's own number where the input's size is not known."""
    size = input_bytes(df)
    if size >= 1 << 60:
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(most, max(1, -(-size // bytes_each)))


def salted(rows: DataFrame, few: DataFrame, key: str, by: Column) -> DataFrame:
    """rows left-joined with few (one row for each key) so that a key's rows are dealt to SALTS tasks; by spreads them."""
    spread = rows.withColumn("__salt", F.pmod(by, F.lit(SALTS)).cast("int"))
    return spread.join(few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, "__salt"], "left").drop("__salt")


def any_of(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out | c
    return out
