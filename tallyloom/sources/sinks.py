"""Files for others: CSV, split training sets, GeoJSON and report structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def write_csv(df: DataFrame, path: str, mark: bool = False) -> None:
    """CSV in UTF-8 with a header; with a byte order ``mark`` for spreadsheets."""
    if mark:
        df = df.toDF("\ufeff" + df.columns[0], *df.columns[1:])
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; a byte order mark before the first name goes."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def write_training_set(rows: DataFrame, path: str) -> None:
    """JSON rows (text, label) below a folder a split."""
    rows.write.mode("overwrite").partitionBy("split").json(path)


def read_training_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, text string, label string, split string").json(path)


def feature(lng: Column, lat: Column, properties: Column) -> Column:
    """A GeoJSON point feature."""
    return F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(lng, lat).alias("coordinates")).alias("geometry"), properties.alias("properties"))


def features(rows: DataFrame, *properties: str) -> DataFrame:
    """One JSON text a row with lng and lat: line-delimited GeoJSON."""
    return rows.where("lat IS NOT NULL AND lng IS NOT NULL").select(F.to_json(feature(F.col("lng"), F.col("lat"), F.struct(*properties))).alias("value"))


def write_geojson(rows: DataFrame, path: str, *properties: str) -> None:
    """A feature a line, as many files as partitions; a collection of a small map is `collection`."""
    features(rows, *properties).write.mode("overwrite").text(path)


def collection(rows: DataFrame, *properties: str) -> DataFrame:
    """One row, one FeatureCollection: for maps of a known small size, as it is one value."""
    return features(rows, *properties).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.sort_array(F.collect_list("value")), ","), F.lit("]}")).alias("value"))
