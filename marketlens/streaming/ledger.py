"""The ledger as a stream: latest state, deduplicated history, throughput, incremental rebuilds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.latest import top_by


def ledger_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 40) -> DataFrame:
    """New files of an append-only folder, a bounded number for each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def latest_state(stream: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key, for update or complete mode (T5)."""
    values = [c for c in stream.columns if c not in keys]
    return stream.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(order)).alias("row")).select(*keys, "row.*")


def deduplicated(stream: DataFrame, keys: list[str], time: str, delay: str | None = None) -> DataFrame:
    """Each key once. Without a delay the state has no bound, as the ledger's own history; with one it is kept so long (T4)."""
    return stream.dropDuplicates(keys) if delay is None else stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def throughput(stream: DataFrame, time: str, width: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Counts in aligned windows; windows close after the delay and late rows are dropped then."""
    stamped = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return stamped.groupBy(F.window(time, width)).agg(F.count("*").alias("events")).select(F.col("window.start").alias("start"), "events")


def incremental(stream: DataFrame, rebuild: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """Calls rebuild(batch, batch id) for each batch. It must replace what it wrote for the same id, since a batch can run again."""
    return stream.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint)


def dirty_keys(batch: DataFrame, keys: list[str]) -> DataFrame:
    return batch.select(*keys).distinct()


def rebuild_latest(ledger: DataFrame, batch: DataFrame, state: DataFrame | None, keys: list[str], order: str) -> DataFrame:
    """The state with the dirty keys' rows computed anew from the whole ledger: equal to a full rebuild."""
    dirty = dirty_keys(batch, keys)
    fresh = top_by(ledger.join(dirty, keys, "left_semi"), keys, [F.desc(order)])
    return fresh if state is None else state.join(dirty, keys, "left_anti").unionByName(fresh)


def converge(step: Callable[[], DataFrame], keys: list[str], passes: int = 3) -> DataFrame:
    """Repeats a step until its keys no longer change, at most `passes` times; an error where they still do."""
    before = None
    for _ in range(passes):
        rows = step()
        now = rows.select(F.count("*"), F.sum(F.xxhash64(*keys).cast("decimal(38,0)"))).head()
        if now == before:
            return rows
        before = now
    raise RuntimeError(f"no convergence after {passes} passes")


def known_pages(pages: DataFrame, known: DataFrame, key: str, history: list[str]) -> DataFrame:
    """Pages of each history up to the second one in a row whose rows were all known (T13, W10). history names its columns."""
    from pyspark.sql import Window

    flagged = pages.join(known.select(key, F.lit(True).alias("known")).distinct(), key, "left").groupBy(*history, "page").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("all_known"))
    runs = flagged.withColumn("before", F.coalesce(F.lag("all_known").over(Window.partitionBy(*history).orderBy("page")), F.lit(False)))
    stop = runs.where("all_known and before").groupBy(*history).agg(F.min("page").alias("stop"))
    return flagged.join(stop, history, "left").where("stop is null or page <= stop").select(*history, "page", "all_known")


def dead_letters(letters: DataFrame, failed: DataFrame) -> DataFrame:
    """Failures recorded once for each item; one that fails again is open again."""
    from ..operators.merge import upsert

    new = failed.groupBy("work_item_id").agg(F.max("failed_at").alias("failed_at"), F.max_by("error", "failed_at").alias("error")).withColumn("status", F.lit("open"))
    return upsert(letters.select("work_item_id", "failed_at", "error", "status"), new, ["work_item_id"])
