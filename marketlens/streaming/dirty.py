"""Dirty keys as a stream: marks come in, bounded ticks rebuild what is marked, marks that come meanwhile stay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.publish import current, generations, publish
from ..sources.shared import settled

MARKS = "ref string, marked_at timestamp_ntz"


class DirtySet:
    """ref and marked_at of what waits, as generations of a folder behind one pointer. done has the last tick, so a batch that Spark runs again is not counted twice."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _table(self, name: str, schema: str) -> DataFrame:
        return current(self.spark, self.folder, name) if generations(self.spark, self.folder) else self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        return self._table("dirty", MARKS)

    def last_tick(self) -> int:
        found = self._table("tick", "tick long").head()
        return -1 if found is None else found["tick"]

    def tick(self, number: int, marks: DataFrame, rebuild: Callable[[DataFrame], DataFrame | None], limit: int) -> None:
        """Adds marks (the later one of a ref counts), rebuilds the `limit` refs that have waited longest, and clears them up to the greatest mark seen before the rebuild.

        rebuild takes the refs, and returns the marks that its work makes, if any: a ref that is marked again there with a
        later time stays dirty.
        """
        if number <= self.last_tick():
            return
        waiting = settled(_latest(self.rows().unionByName(marks.select("ref", "marked_at"))), "waiting")
        before = F.broadcast(waiting.agg(F.max("marked_at").alias("before")))  # one row
        chosen = settled(waiting.orderBy("marked_at", "ref").limit(limit), "chosen")
        again = rebuild(chosen.select("ref"))
        if again is not None:
            waiting = _latest(waiting.unionByName(again.select("ref", "marked_at")))
        done = chosen.select("ref", F.lit(True).alias("done"))
        left = waiting.join(done, "ref", "left").crossJoin(before).where(F.col("done").isNull() | (F.col("marked_at") > F.col("before"))).select("ref", "marked_at")
        publish(self.spark, self.folder, {"dirty": left, "tick": self.spark.createDataFrame([(number,)], "tick long")})

    def follow(self, marks: DataFrame, rebuild: Callable[[DataFrame], DataFrame | None], limit: int, checkpoint: str) -> None:
        """Runs a tick for each batch of a stream of marks, up to what is there now. A second call with the same checkpoint goes on where the first one ended."""
        run = marks.writeStream.foreachBatch(lambda batch, number: self.tick(number, batch, rebuild, limit)).option("checkpointLocation", checkpoint)
        run.trigger(availableNow=True).start().awaitTermination()

    def drain(self, rebuild: Callable[[DataFrame], DataFrame | None], limit: int, most: int = 1000) -> int:
        """Ticks without new marks until nothing waits; how many there were."""
        for ticks in range(most):
            if self.rows().isEmpty():
                return ticks
            self.tick(self.last_tick() + 1, self.spark.createDataFrame([], MARKS), rebuild, limit)
        raise RuntimeError(f"still dirty after {most} ticks")


def _latest(marks: DataFrame) -> DataFrame:
    return marks.groupBy("ref").agg(F.max("marked_at").alias("marked_at"))


def marked_state(stream: DataFrame) -> DataFrame:
    """ref, marked_at, cleared_to, marks, dirty of a stream of marks and clearings (ref, at, cleared): a ref is dirty while its last mark is after what was cleared. For update or complete mode; the state store holds one row for each ref."""
    found = stream.groupBy("ref").agg(F.max(F.when(~F.col("cleared"), F.col("at"))).alias("marked_at"), F.max(F.when(F.col("cleared"), F.col("at"))).alias("cleared_to"), F.count_if(~F.col("cleared")).alias("marks"))
    return found.withColumn("dirty", F.col("marked_at").isNotNull() & (F.col("cleared_to").isNull() | (F.col("marked_at") > F.col("cleared_to"))))


def run_available(stream: DataFrame, target: str, checkpoint: str) -> None:
    """One run over what is there now, in complete mode: each batch's whole result replaces the one before as a generation of target."""
    spark = stream.sparkSession
    run = stream.writeStream.outputMode("complete").foreachBatch(lambda batch, _: publish(spark, target, {"state": batch}) and None).option("checkpointLocation", checkpoint)
    run.trigger(availableNow=True).start().awaitTermination()
