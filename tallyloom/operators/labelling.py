"""A label tier above the rules: complement naive Bayes, trained on labelled reviews by aggregates alone.

A class's score is how badly its complement, the texts of all other classes, explains a text's
words.  With n(c, w) for how often word w stands in texts of class c, n(w) and n(c) for its sums,
V words and smoothing a, the weight of a word for a class is ln(a + n(w) - n(c, w)), less the
logarithm of aV + n - n(c); the class of least sum wins.  Only words that a class has seen
differ from ln(a + n(w)), which is the same for all classes, so the table holds just these
differences: it is as sparse as the counts.  Differences are whole millionths, so sums are
exact in any order.

A model has at most ``most_words`` words, the most frequent; that bounds what goes to the tasks.

Defined results: rows without text, label or words teach nothing; a text without known words gets
the class that most words of the training set belong to; equal sums go to the label that
comes first; a model of no rows labels nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.functions import text as x
from tallyloom.sources.scratch import cut

UNIT = 1_000_000
#: Texts whose words a task holds as numbers at a time.
ROWS = 64


def words_of(text: Column) -> Column:
    """Lower-case words of two characters and more, with one space between them."""
    return F.lower(F.array_join(x.tokens(text), " "))


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How often each word stands in the texts of a label, for each batch of (label, words)."""
    for batch in batches:
        counts = [(label, word, n) for label, own in batch.groupby("label")["words"] for word, n in Counter(w for said in own for w in said.split(" ")).items() if word]
        yield pd.DataFrame(counts, columns=["label", "word", "n"])


@dataclass
class Model:
    """``weights`` (word, held: [(label, weight)]) and ``classes`` (label, bias), in millionths."""

    weights: DataFrame
    classes: list[tuple[str, int]]

    def scored(self, text: Column) -> Column:
        """``(label, score, margin)`` of a text: the best class, its sum, and how far the next one is behind.

        A text is scored where it stands: the model, of bounded size, goes to the tasks, so that no words are shuffled.
        """
        kind = "label string, score long, margin long"
        if not self.classes:
            return F.lit(None).cast(f"struct<{kind.replace(' ', ':').replace(',:', ',')}>")
        labels, biases = [label for label, _ in self.classes], np.array([bias for _, bias in self.classes], dtype=np.int64)
        held = self.weights.collect()  # at most most_words rows
        at, column = {r["word"]: i for i, r in enumerate(held)}, {label: k for k, label in enumerate(labels)}
        # Words that the model doesn't have are its last row, of zeros.
        table = np.zeros((len(held) + 1, len(labels)), dtype=np.int64)
        for i, r in enumerate(held):
            for label, weight in r["held"]:
                table[i, column[label]] = weight

        @F.pandas_udf(kind)
        def best(said: pd.Series) -> pd.DataFrame:
            scores = np.empty((len(said), len(labels)), dtype=np.int64)
            for first in range(0, len(said), ROWS):
                words = [t.split(" ") for t in said.iloc[first : first + ROWS]]
                found = np.array([at.get(w, len(at)) for row in words for w in row], dtype=np.int64)
                starts = np.cumsum([0] + [len(row) for row in words[:-1]])
                known = np.add.reduceat((found < len(at)).astype(np.int64), starts)[:, None]
                # Words that the model doesn't have weigh alike for all classes, but for the bias that each word brings.
                scores[first : first + ROWS] = np.where(known > 0, np.add.reduceat(table[found], starts) - known * biases, biases)
            # Labels are in order, so the first of equal sums comes first.
            order = np.argsort(scores, axis=1, kind="stable")
            least = np.take_along_axis(scores, order[:, :2], axis=1)
            margin = pd.Series(least[:, 1] - least[:, 0], dtype="Int64") if len(labels) > 1 else pd.Series([None] * len(said), dtype="Int64")
            return pd.DataFrame({"label": np.array(labels, dtype=object)[order[:, 0]], "score": least[:, 0], "margin": margin})

        return best(words_of(F.coalesce(text, F.lit(""))))

    def predict(self, rows: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
        """``(key, label, score, margin)`` of :meth:`scored`."""
        return rows.select(key, self.scored(F.col(text)).alias("_best")).select(key, "_best.*")


def fit(rows: DataFrame, smoothing: float = 1.0, most_words: int = 50_000) -> Model:
    """A model from ``(text, label)`` rows."""
    told = rows.where("text IS NOT NULL AND label IS NOT NULL").select("label", words_of(F.col("text")).alias("words"))
    counted = told.mapInPandas(_counted, "label string, word string, n long")
    counts = cut(counted.groupBy("label", "word").agg(F.sum("n").alias("n")))
    words = counts.groupBy("word").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "word").limit(most_words)
    kept = counts.join(F.broadcast(words), "word")
    sums = {r["label"]: r["n"] for r in kept.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    n_words = kept.select("word").distinct().count()
    n = sum(sums.values())
    biases = kept.sparkSession.createDataFrame([(label, float(smoothing * n_words + n - c)) for label, c in sums.items()], "label string, mass double").select("label", whole(F.ln("mass")).alias("bias")).collect()
    weight = whole(F.ln(smoothing + F.col("total") - F.col("n"))) - whole(F.ln(smoothing + F.col("total")))
    weights = kept.groupBy("word").agg(F.collect_list(F.struct("label", weight.alias("weight"))).alias("held"))
    return Model(cut(weights), sorted((r["label"], r["bias"]) for r in biases))


def whole(value: Column) -> Column:
    """A logarithm in whole millionths."""
    return F.round(value * UNIT).cast("long")


def tier(sentiment: Model, category: Model, name: str = "complement-bayes"):
    """A ``classify`` function for :func:`tallyloom.streaming.ingest.label_new`; reviews without text are left to the rules."""

    def classify(reviews: DataFrame) -> DataFrame:
        rows = reviews.where(F.trim(F.coalesce("text_clean", F.lit(""))) != "")
        both = rows.withColumn("sentiment", sentiment.scored(F.col("text_clean"))["label"]).withColumn("pain_point_category", category.scored(F.col("text_clean"))["label"])
        severity = x.severity_gate(F.col("sentiment"), F.col("pain_point_category"), F.col("rating"))
        return both.select(F.col("id").alias("review_id"), "sentiment", "pain_point_category", severity.alias("severity"), x.keywords(F.col("text_clean")).alias("keywords"), F.lit(name).alias("model_used"))

    return classify
