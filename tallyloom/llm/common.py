"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset
    (a local session, as in tests) a temporary folder is made and registered.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tallyloom-"))
    return sc.getCheckpointDir().rstrip("/")


def work_dir(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/tallyloom-{label}-{uuid.uuid4().hex}"


def column(name: str) -> Column:
    """A column of that very name: dots and backticks in it mean nothing."""
    return F.col(f"`{name.replace('`', '``')}`")


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df``, whatever their names, as one struct."""
    return F.struct(*(column(c) for c in df.columns))


def in_arrow(df: DataFrame, run) -> DataFrame:
    """``mapInArrow`` that keeps the columns, which it takes by their places: they may have any names."""
    plain = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: whatever is built on the result survives lost executors
    and never repeats the work (or the row order) that made it.
    """
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete tables made by :func:`stored` that no later plan reads."""
    for df in frames:
        path = getattr(df, "_stored_at", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
