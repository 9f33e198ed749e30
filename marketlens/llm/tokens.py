"""Operator 4: token ids as ORC files.

Documents are ranged by doc_id over files and sorted within; each file's stripes hold the ids run-length encoded
(ORC's version 2 for integers), with row indexes and a Bloom filter on doc_id, so that readers split by stripe and
skip by metadata. A row also has its file's number, its number of ids and the ids before it in that file; the ids before a whole file
come from one sum for each file, so nothing is counted in one task.

Defined cases: null text is empty and gives the end id alone; null doc_id comes first; rows with the same doc_id are
ordered by their text's hash, and may stand in several files; repeated rows get a row each; further columns are ignored;
an empty table writes no row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import BYTE_BPE, encoder, slices
from .common import documents, parts_for, scratch, tidy

END = 2
FILE_BYTES = 32 << 20
ORC = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "2000", "orc.stripe.size": str(16 << 20), "orc.compress": "ZSTD"}
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("file", T.IntegerType()), T.StructField("before", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])


def with_end(ids: np.ndarray, places: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Puts an id behind each text's ids."""
    return np.insert(ids, places[1:], end), places + np.arange(len(places))


def write(docs: DataFrame, path: str, tokenizer: str = BYTE_BPE, end: int = END) -> None:
    """Writes one row for each row of docs, doc_id ascending over the files in the order of their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, file, before = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch):
                ids, places = with_end(*made.flat(part.column("text")), end)
                lists = pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), pa.array(ids.view("<i4")))
                yield pa.record_batch([part.column("doc_id"), pa.array(np.full(len(lists), file, np.int32)), pa.array(before + places[:-1]), pa.array(np.diff(places)), lists], names=SCHEMA.names)
                before += int(places[-1])

    rows = documents(docs).withColumn("tag", F.xxhash64("text"))
    ranged = rows.repartitionByRange(parts_for(docs, FILE_BYTES), "doc_id", "tag").sortWithinPartitions("doc_id", "tag").select("doc_id", "text")
    ranged.mapInArrow(tidy(run, "bpe"), SCHEMA).write.options(**ORC).orc(path)


def offsets(rows: DataFrame, group: str, size: str, offset: str) -> DataFrame:
    """rows, one for each group, with the total size of all groups of smaller number. Groups are files or tasks, of which parts_for() bounds the number, so one window holds them."""
    return rows.withColumn(offset, F.coalesce(F.sum(size).over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids from the files."""
    rows = spark.read.schema(SCHEMA).orc(path)
    sums = rows.groupBy("file").agg(F.sum("n_ids").alias("size"))  # reads no ids
    table = offsets(sums, "file", "size", "file_start").select("file", "file_start")
    return rows.join(F.broadcast(table), "file").select("doc_id", (F.col("file_start") + F.col("before")).alias("start"), "ids")


@F.arrow_udf(T.LongType())
def crc_of(lists: pa.Array) -> pa.Array:
    values, places = lists.flatten().to_numpy(zero_copy_only=False).astype("<i4"), lists.offsets.to_numpy()
    data, places = memoryview(values.tobytes()), (places - places[0]) * 4
    return pa.array([zlib.crc32(data[a:b]) for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)], pa.int64())


def digest(docs: DataFrame, tokenizer: str = BYTE_BPE) -> DataFrame:
    """Writes the files to the shared folder and returns doc_id, start, n_tokens, ids_crc32 as read back."""
    path = scratch(docs.sparkSession, "token-ids")
    write(docs, path, tokenizer)
    return read(docs.sparkSession, path).select("doc_id", "start", F.size("ids").cast("long").alias("n_tokens"), crc_of("ids").alias("ids_crc32"))
