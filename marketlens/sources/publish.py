"""Immutable generations of tables behind a pointer file."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def publish(spark: SparkSession, folder: str, tables: dict[str, DataFrame], validate: Callable[[dict[str, DataFrame]], None] | None = None, keep: int = 3) -> str:
    """Writes a new generation, validates what was written, and only then moves the pointer; older generations beyond `keep` go."""
    name = f"gen={uuid.uuid4().hex}"
    for table, df in tables.items():
        df.write.parquet(f"{folder}/{name}/{table}")
    if validate is not None:
        validate({table: spark.read.parquet(f"{folder}/{name}/{table}") for table in tables})
    before = generations(spark, folder)
    names = [name, *before][:keep]
    point(spark, folder, {"current": name, "generations": names, "tables": sorted(tables)})
    jvm, files, _ = _files(spark, folder)
    for old in before[keep - 1 :]:
        files.delete(jvm.org.apache.hadoop.fs.Path(f"{folder}/{old}"), True)
    return name


def point(spark: SparkSession, folder: str, what: dict) -> None:
    """Replaces the pointer file by a rename, so a reader finds the old or the new one."""
    jvm, files, part = _files(spark, f"{folder}/.current.{uuid.uuid4().hex}")
    out = files.create(part)
    out.write(bytearray(json.dumps(what).encode()))
    out.close()
    pointer = jvm.org.apache.hadoop.fs.Path(f"{folder}/current.json")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(files.makeQualified(part), files.makeQualified(pointer), overwrite)


def _pointer(spark: SparkSession, folder: str) -> dict:
    _, files, path = _files(spark, f"{folder}/current.json")
    if not files.exists(path):
        return {}
    return json.loads(spark.read.option("wholetext", True).text(f"{folder}/current.json").head()[0])


def generations(spark: SparkSession, folder: str) -> list[str]:
    return _pointer(spark, folder).get("generations", [])


def current(spark: SparkSession, folder: str, table: str) -> DataFrame:
    found = _pointer(spark, folder)
    if not found:
        raise FileNotFoundError(f"nothing is published in {folder}")
    return spark.read.parquet(f"{folder}/{found['current']}/{table}")
