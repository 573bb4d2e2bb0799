"""Classifier evaluation: confusion counts, precision and recall, agreement, splits and leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.functions import domain, filters as f, measures as m
from tallyloom.sources.scratch import cut
from tallyloom.tables import Tables

# Models whose labels count as truth for training.
TRUSTED = {
    "category": ("claude-haiku-4-5", "claude-haiku-4-5-20251001", "claude-haiku-4-5-full"),
    "sentiment": ("claude-haiku-4-5-20251001", "claude-haiku-4-5-full"),
}
LEAST_SAMPLES = 40
# End of fixed values.


def confusion(rows: DataFrame, gold="gold", predicted="pred") -> DataFrame:
    """Counts of (gold, pred) pairs."""
    return rows.groupBy(F.col(gold).alias("gold"), F.col(predicted).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(rows: DataFrame, labels: list, gold="gold", predicted="pred") -> DataFrame:
    return rows.groupBy(F.col(gold).alias("gold")).pivot(predicted, labels).count().fillna(0)


def confused(rows: DataFrame, k=10) -> DataFrame:
    """Most frequent mistakes."""
    return confusion(rows).where("gold != pred").orderBy(F.desc("n"), "gold", "pred").limit(k)


def per_class(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every class, 0 where there is nothing to divide by."""
    gold = counts.groupBy(F.col("gold").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)).alias("hit"))
    pred = counts.groupBy(F.col("pred").alias("class")).agg(F.sum("n").alias("predicted"))
    rows = gold.join(pred, "class", "full").fillna(0, ["support", "hit", "predicted"])
    zero = lambda a, b: F.coalesce(m.rate(F.col(a), F.col(b)), F.lit(0.0))
    rows = rows.withColumns({"precision": zero("hit", "predicted"), "recall": zero("hit", "support")})
    return rows.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def overall(counts: DataFrame) -> DataFrame:
    """One row: accuracy, macro and weighted F1."""
    rows = per_class(counts)
    return rows.agg((F.sum("hit") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"), F.sum("support").alias("n"))


def agreement(counts: DataFrame) -> DataFrame:
    """One row: n, agree, Cohen's kappa and its word."""
    marginal = lambda c: counts.groupBy(F.col(c).alias("label")).agg(F.sum("n").alias(c))
    chance = marginal("gold").join(marginal("pred"), "label").agg(F.sum(F.col("gold").cast("double") * F.col("pred")).alias("chance"))
    whole = counts.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)).alias("agree"))
    po, pe = F.col("agree") / F.col("n"), F.col("chance") / (F.col("n").cast("double") * F.col("n"))
    rows = whole.crossJoin(chance).withColumn("kappa", F.try_divide(po - pe, 1 - pe))
    return rows.withColumn("word", kappa_word(F.col("kappa"))).drop("chance")


def kappa_word(kappa: Column) -> Column:
    """Landis and Koch."""
    return F.when(kappa.isNull(), None).when(kappa < 0, "worse than chance").when(kappa <= 0.20, "slight").when(kappa <= 0.40, "fair").when(kappa <= 0.60, "moderate").when(kappa <= 0.80, "good").otherwise("very good")


def training_rows(t: Tables, task="category", least_length=10) -> DataFrame:
    """(id, text, label) of reviews labelled by a trusted model."""
    label = F.col("pain_point_category" if task == "category" else "sentiment")
    rows = t.labelled().where(F.col("model_used").isin(*TRUSTED[task]) & f.has_text() & (F.length("text_clean") >= least_length) & label.isNotNull())
    return rows.select("id", F.col("text_clean").alias("text"), label.alias("label"))


def clean_labels(rows: DataFrame, task="category", least=LEAST_SAMPLES) -> DataFrame:
    """Rare categories become other; mixed feelings become negative, unknown ones go."""
    if task != "category":
        return rows.withColumn("label", F.when(F.col("label") == "mixed", "negative").otherwise(F.col("label"))).where(F.col("label").isin(*domain.SENTIMENTS))
    rare = rows.groupBy("label").agg(F.count(F.lit(1)).alias("c")).where((F.col("c") < least) | (F.col("label") == "ไม่มี")).select("label", F.lit(True).alias("rare"))
    return rows.join(rare, "label", "left").withColumn("label", F.when(F.col("rare"), domain.OTHER).otherwise(F.col("label"))).drop("rare")


def _numbered(rows: DataFrame, label: str, seed: int, key: str) -> DataFrame:
    """Rows with their place within their label (_n, from 1) in order of a hash of the key, and the label's rows (_c).

    Rows are sorted in ranges of label and hash, and counted on from each range's offset, so
    a label that most rows have is no single task's work.
    """
    hashed = rows.withColumn("_h", F.xxhash64(F.lit(seed), key))
    placed = cut(hashed.repartitionByRange(label, "_h", key).sortWithinPartitions(label, "_h", key).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumns({"_part": F.shiftright("_at", 33), "_place": F.col("_at").bitwiseAND((1 << 33) - 1)})
    # A row for each range and label in it.
    held = placed.groupBy("_part", F.col(label).alias("_label")).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_size"))
    upto = F.sum("_size").over(Window.partitionBy("_label").orderBy("_part"))
    ahead = held.select(F.col("_part").alias("_p"), "_label", (upto - F.col("_size") - F.col("_first") + 1).alias("_ahead"), F.sum("_size").over(Window.partitionBy("_label")).alias("_c"))
    joined = placed.join(ahead, (F.col("_part") == F.col("_p")) & F.col(label).eqNullSafe(F.col("_label")))
    return joined.select(*rows.columns, (F.col("_place") + F.col("_ahead")).alias("_n"), "_c")


def split(rows: DataFrame, seed=42, key="id") -> DataFrame:
    """Each label's rows as 15 % test, 15 % val (one at least) and the rest train, by a hash of the key."""
    rows = _numbered(rows, "label", seed, key)
    part = F.greatest(F.lit(1), F.floor(F.col("_c") * 0.15))
    return rows.withColumn("split", F.when(F.col("_n") <= part, "test").when(F.col("_n") <= 2 * part, "val").otherwise("train")).drop("_n", "_c")


def quota_sample(rows: DataFrame, quota: int, seed=42, key="id", label="label") -> DataFrame:
    """At most ``quota`` rows of each label, picked by a hash."""
    return _numbered(rows, label, seed, key).where(F.col("_n") <= quota).drop("_n", "_c")


def random_sample(rows: DataFrame, n: int, seed=42, key="id") -> DataFrame:
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def class_weights(rows: DataFrame) -> DataFrame:
    """1 / sqrt(count), with mean 1."""
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("w", 1 / F.sqrt("n"))
    return counts.crossJoin(counts.agg(F.avg("w").alias("mean"))).select("label", "n", (F.col("w") / F.col("mean")).alias("weight"))


def leakage(gold: DataFrame, splits: DataFrame) -> DataFrame:
    """Gold rows whose text is in a split, in which ones, and whether the model has seen it."""
    where = splits.groupBy(F.trim("text").alias("_text")).agg(F.sort_array(F.collect_set("split")).alias("found"))
    rows = gold.join(where, F.trim(gold["text"]) == F.col("_text"))
    return rows.select(*gold.columns, F.array_join("found", "+").alias("splits"), F.arrays_overlap("found", F.array(F.lit("train"), F.lit("val"))).alias("leaked"))


def gain(base: Column, new: Column) -> Column:
    """Relative gain of one model over another."""
    return (new - base) / F.greatest(base, F.lit(0.001))
