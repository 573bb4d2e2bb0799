"""The label tier against the textbook formula, and as a classifier of new reviews."""

import math
from collections import Counter

from tallyloom.operators import labelling
from tallyloom.streaming import ingest

ROWS = [("good food good price", "positive"), ("bad food", "negative"), ("bad bad service slow", "negative"), ("it was fine", "neutral"), (None, "positive"), ("", "positive"), ("no label here", None)]
TOLD = [(t, c) for t, c in ROWS if t and c]


def by_formula(text):
    """Least sum over words of the log of the complement's share."""
    n = {c: Counter(w for t, k in TOLD if k == c for w in t.split()) for _, c in TOLD}
    every = sum(n.values(), Counter())
    v, total = len(every), sum(every.values())
    words = [w for w in text.split() if w in every]
    if not words:
        return max(n, key=lambda c: sum(n[c].values()))
    return min(sorted(n), key=lambda c: sum(math.log((1 + every[w] - n[c][w]) / (v + total - sum(n[c].values()))) for w in words))


def test_formula(spark):
    model = labelling.fit(spark.createDataFrame(ROWS, "text string, label string"))
    texts = ["good price", "bad slow food", "fine", "food", "food food bad good", "unheard words", "", "it was bad", "price service it"]
    got = {r["id"]: r["label"] for r in model.predict(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect()}
    assert got == {i: by_formula(t) for i, t in enumerate(texts)}
    assert model.predict(spark.createDataFrame([(1, None)], "id long, text string")).first()["label"] == "negative"


def test_bounded_words(spark):
    model = labelling.fit(spark.createDataFrame(ROWS, "text string, label string"), most_words=2)
    assert {r["word"] for r in model.weights.collect()} == {"bad", "food"}


def test_empty_training(spark):
    model = labelling.fit(spark.createDataFrame([], "text string, label string"))
    assert model.predict(spark.createDataFrame([(1, "a text")], "id long, text string")).first()["label"] is None


def test_tier_over_rules(spark):
    rows = spark.createDataFrame(ROWS, "text string, label string")
    about = spark.createDataFrame([("good food good price bad", "food"), ("slow service", "service")], "text string, label string")
    reviews = spark.createDataFrame([(1, "bad slow service", 1), (2, "good price", 5), (3, "", 4), (4, None, 1), (5, "known already", 2)], "id long, text_clean string, rating int")
    analyzed = spark.createDataFrame([(5,)], "review_id long")
    got = {r["review_id"]: r for r in ingest.label_new(reviews, analyzed, labelling.tier(labelling.fit(rows), labelling.fit(about))).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert (got[1]["sentiment"], got[1]["pain_point_category"], got[1]["severity"], got[1]["model_used"]) == ("negative", "service", "high", "complement-bayes")
    assert (got[2]["sentiment"], got[2]["severity"]) == ("positive", "low")
    assert {got[3]["model_used"], got[4]["model_used"]} == {"rules"}


def test_texts_are_scored_without_a_shuffle(spark, small):
    model = labelling.fit(spark.createDataFrame(ROWS, "text string, label string"))
    plan = model.predict(spark.read.parquet(f"{small}/documents.parquet"), key="doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_margin(spark):
    one = labelling.fit(spark.createDataFrame(ROWS[:1], "text string, label string"))
    assert tuple(one.predict(spark.createDataFrame([(1, "good")], "id long, text string")).first())[1::2] == ("positive", None)
    model = labelling.fit(spark.createDataFrame(ROWS, "text string, label string"))
    got = model.predict(spark.createDataFrame([(i, "bad food " * i) for i in range(200)], "id long, text string")).orderBy("id").collect()
    assert [r["margin"] > 0 for r in got[1:]] == [True] * 199 and got[2]["score"] == 2 * got[1]["score"]
