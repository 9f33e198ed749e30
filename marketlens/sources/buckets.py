"""Tables in buckets of a parent key: a publication writes the buckets that it touches and points at the others."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .publish import _files, _pointer, point
from .shared import settled


class BucketedTable:
    """Children by parent. The pointer file says for each bucket which generation's folder has it; readers take the pointer once, so they see one generation.

    `buckets` bounds the pointer and how fine a publication is: of n touched parents at most n buckets are written. Folders
    that none of the last `keep` generations points at are deleted.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, parent: str, buckets: int = 1024, keep: int = 3):
        self.spark, self.folder, self.schema, self.parent, self.buckets, self.keep = spark, folder, schema, parent, buckets, keep

    def _bucket(self):
        return F.pmod(F.xxhash64(self.parent), F.lit(self.buckets)).cast("int")

    def _paths(self) -> dict[str, str]:
        return _pointer(self.spark, self.folder).get("buckets", {})

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/{p}" for p in sorted(paths)))

    def read(self) -> DataFrame:
        return self._read(list(self._paths().values()))

    def children(self, parents: list) -> DataFrame:
        """The children of a few parents, out of their buckets alone."""
        wanted = self.spark.createDataFrame([(p,) for p in parents], StructType([self.schema[self.parent]]))
        numbers = {str(r[0]) for r in wanted.select(self._bucket()).distinct().collect()}
        return self._read([p for b, p in self._paths().items() if b in numbers]).join(F.broadcast(wanted), self.parent, "left_semi")  # the parents named

    def replace(self, rows: DataFrame, touched: DataFrame | None = None) -> list[int]:
        """Children of the touched parents (by default those of rows) become those of rows; the buckets written. touched: the parent column; without rows of its own a parent loses its children."""
        rows = settled(rows.select(*self.schema.names), "rows")
        parents = settled((rows if touched is None else touched.select(F.col(touched.columns[0]).alias(self.parent))).select(self.parent).distinct(), "touched")
        numbers = sorted(r[0] for r in parents.select(self._bucket()).distinct().collect())  # at most `buckets`
        pointer = _pointer(self.spark, self.folder)
        before = pointer.get("buckets", {})
        stay = self._read([before[str(n)] for n in numbers if str(n) in before]).join(parents, self.parent, "left_anti")
        name = f"gen={uuid.uuid4().hex}"
        # only children of touched parents, so that no bucket beside those named is written
        fresh = rows.join(parents, self.parent, "left_semi").select(*self.schema.names)
        whole = stay.select(*self.schema.names).unionByName(fresh).withColumn("__bucket", self._bucket())
        whole.repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.folder}/{name}")
        written = {r[0] for r in self.spark.read.parquet(f"{self.folder}/{name}").select("__bucket").distinct().collect()} if numbers and self._some(name) else set()
        now = {b: p for b, p in before.items() if int(b) not in numbers} | {str(n): f"{name}/__bucket={n}" for n in written}
        generations = [sorted({p.split("/")[0] for p in now.values()}), *pointer.get("generations", [])][: self.keep]
        point(self.spark, self.folder, {"buckets": now, "generations": generations})
        self._clear({g for names in generations for g in names})
        return sorted(written)

    def _some(self, name: str) -> bool:
        _, files, path = _files(self.spark, f"{self.folder}/{name}")
        return any(s.isDirectory() for s in files.listStatus(path))

    def _clear(self, needed: set[str]) -> None:
        _, files, path = _files(self.spark, self.folder)
        for status in files.listStatus(path):
            name = status.getPath().getName()
            if name.startswith("gen=") and name not in needed:
                files.delete(status.getPath(), True)
