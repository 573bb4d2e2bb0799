"""Tables kept as numbered versions below one folder.

A version is a small file ``m<number>`` that lists folders of rows (parts).  A change
writes its parts first and then the list, under a name that no version has yet, in one
rename; readers take the greatest number.  So nothing is ever deleted or replaced: a
change that breaks off leaves the version before it, and readers of old versions go on.
An append lists the old parts and its own, and so writes new rows only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, folder: str) -> list[int]:
    fs, at = _fs(spark, folder)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n[1:]) for n in names if n[:1] == "m" and n[1:].isdigit())


def current(spark: SparkSession, folder: str) -> int | None:
    """The version that readers see."""
    return max(versions(spark, folder), default=None)


def parts(spark: SparkSession, folder: str, number: int | None = None) -> list[str]:
    """Names of the folders of rows of a version (the current one)."""
    number = current(spark, folder) if number is None else number
    if number is None:
        return []
    return sorted(r[0] for r in spark.read.text(f"{folder}/m{number}").collect() if r[0])


def read(spark: SparkSession, folder: str, number: int | None = None) -> DataFrame:
    names = parts(spark, folder, number)
    if not names:
        raise ValueError(f"no version in {folder}")
    return spark.read.parquet(*(f"{folder}/{n}" for n in names))


def _part(df: DataFrame, folder: str, partition_by: tuple[str, ...]) -> str:
    name = f"p-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(f"{folder}/{name}")
    return name


def write(df: DataFrame, folder: str, partition_by: tuple[str, ...] = ()) -> int:
    """Write all rows anew as the next version."""
    return publish(df.sparkSession, folder, [_part(df, folder, partition_by)])


def append(df: DataFrame, folder: str, partition_by: tuple[str, ...] = ()) -> int:
    """The next version: the rows of the current one and these."""
    held = parts(df.sparkSession, folder)
    return publish(df.sparkSession, folder, [*held, _part(df, folder, partition_by)])


def publish(spark: SparkSession, folder: str, names: list[str]) -> int:
    """Make a version of parts that are whole; an older version comes back by its own ``parts``."""
    number = max(versions(spark, folder), default=-1) + 1
    fs, fresh = _fs(spark, f"{folder}/next-{uuid.uuid4().hex}")
    out = fs.create(fresh, True)
    out.write(bytearray("\n".join(names), "utf-8"))
    out.close()
    final = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/m{number}")
    if fs.exists(final) or not fs.rename(fresh, final):
        raise RuntimeError(f"version {number} of {folder} was written by another change")
    return number
