"""Connected components of an edge table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyloom.llm import common


def _digest(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


def _large_star(edges: DataFrame) -> DataFrame:
    ends = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")
    both = edges.select(ends).select("e.*")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
    return moved.select("e.*").where("u != v").distinct()


def components(edges: DataFrame, rows_in_one_task: int = 200_000) -> DataFrame:
    """``(u, v)`` edges to ``(node, root)``, the least node of each component; roots are left out.

    Alternates large and small stars, so the number of rounds grows with the logarithm of
    the size of a component.  Every round is written to the shared folder.  A table of at
    most ``rows_in_one_task`` edges needs no exchanges: one task does its round.
    """
    now = common.stored(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _digest(now)
    while seen[0]:
        dealt = now.coalesce(1) if seen[0] <= rows_in_one_task else now
        after = common.stored(_small_star(_large_star(dealt)), "edges")
        common.forget(now)
        now, before, seen = after, seen, _digest(after)
        if seen == before:
            break
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out._stored_at = now._stored_at
    return out
