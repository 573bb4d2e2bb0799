"""Event-time windows on streams (an extension: the domain itself counts in batches)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def event_time(df: DataFrame, column="ts") -> DataFrame:
    """Time columns without zone can't carry a watermark: read them as UTC."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def weekly(df: DataFrame, column="ts") -> Column:
    """Seven days from Monday (the epoch was a Thursday)."""
    return F.window(column, "7 days", "7 days", "4 days")


def counts(df: DataFrame, window: Column, late: str, *by: str, column="ts", value="value") -> DataFrame:
    """Rows and sum of a value by window and keys; later rows than ``late`` may be dropped."""
    grouped = event_time(df, column).withWatermark(column, late).groupBy(window.alias("w"), *by)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *by, "n", "total")


def tumbling(df: DataFrame, *by: str, late="1 day", column="ts") -> DataFrame:
    return counts(df, weekly(df, column), late, *by, column=column)


def sliding(df: DataFrame, *by: str, size="7 days", step="1 day", late="1 day", column="ts") -> DataFrame:
    return counts(df, F.window(column, size, step), late, *by, column=column)


def sessions(df: DataFrame, *by: str, gap="1 hour", late="1 day", column="ts") -> DataFrame:
    return counts(df, F.session_window(column, gap), late, *by, column=column)


def distinct_texts(df: DataFrame, text="text") -> DataFrame:
    """Rows of a stream whose text has not been seen."""
    return df.withColumn("text_hash", F.md5(text)).dropDuplicates(["text_hash"])
