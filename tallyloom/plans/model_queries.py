"""Models trained on the driver's tables: word segmentation and the label tier, with what they predict."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import domain
from tallyloom.operators import evaluate, labelling, segmentation
from tallyloom.plans.registry import over_files, over_star
from tallyloom.streaming import ingest


def words_sql(text: str) -> str:
    """A text's words, as labelling.words_of gives them."""
    bare = rf"trim(regexp_replace(regexp_replace({text}, 'http\S+|www\.\S+|<[^>]+>|[^\x{{0E00}}-\x{{0E7F}}\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}\s]', ' ', 'g'), '\s+', ' ', 'g'))"
    return f"[lower(w) for w in string_split({bare}, ' ') if length(w) >= 2]"


def bayes_sql(name: str, taught: str) -> str:
    """Weights and biases of a model that ``taught`` (text, label) rows train, as CTEs that begin with ``name``."""
    return f"""{name}_cw AS (SELECT label, word, count(*) AS n FROM (SELECT label, unnest({words_sql("text")}) AS word FROM ({taught}) WHERE text IS NOT NULL AND label IS NOT NULL) GROUP BY ALL),
{name}_t AS (SELECT word, sum(n) AS total FROM {name}_cw GROUP BY 1 ORDER BY total DESC, word LIMIT 50000),
{name}_k AS (SELECT * FROM {name}_cw JOIN {name}_t USING (word)),
{name}_b AS (SELECT label, CAST(round(1000000 * ln((SELECT count(DISTINCT word) + sum(n) FROM {name}_k) - sum(n))) AS BIGINT) AS bias FROM {name}_k GROUP BY 1),
{name}_w AS (SELECT label, word, CAST(round(1000000 * ln(1 + total - n)) AS BIGINT) - CAST(round(1000000 * ln(1 + total)) AS BIGINT) AS weight FROM {name}_k)"""


def predicted_sql(name: str, rows: str) -> str:
    """(id, label, score) of ``rows`` (id, text) under a model of :func:`bayes_sql`."""
    return f"""SELECT id, label, score FROM (
  SELECT r.id, b.label, CASE WHEN coalesce(l.length, 0) > 0 THEN coalesce(s.weight, 0) - l.length * b.bias ELSE b.bias END AS score, row_number() OVER (PARTITION BY r.id ORDER BY CASE WHEN coalesce(l.length, 0) > 0 THEN coalesce(s.weight, 0) - l.length * b.bias ELSE b.bias END, b.label) AS n
  FROM ({rows}) r CROSS JOIN {name}_b b
  LEFT JOIN (SELECT id, CAST(sum(n) AS BIGINT) AS length FROM (SELECT id, word, count(*) AS n FROM (SELECT id, unnest({words_sql("text")}) AS word FROM ({rows})) GROUP BY ALL) WHERE word IN (SELECT word FROM {name}_t) GROUP BY 1) l ON l.id = r.id
  LEFT JOIN (SELECT id, label, CAST(sum(n * weight) AS BIGINT) AS weight FROM (SELECT id, word, count(*) AS n FROM (SELECT id, unnest({words_sql("text")}) AS word FROM ({rows})) GROUP BY ALL) JOIN {name}_w USING (word) GROUP BY 1, 2) s ON s.id = r.id AND s.label = b.label) WHERE n = 1"""


HELD_OUT = "substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) IN ('0', '1', '2')"
LANGUAGES = bayes_sql("m", f"SELECT text, lang AS label FROM documents WHERE NOT {HELD_OUT}")
TOLD = f"WITH {LANGUAGES}, p AS ({predicted_sql('m', 'SELECT doc_id AS id, text FROM documents')}), c AS (SELECT {HELD_OUT} AS held_out, d.lang AS gold, p.label AS pred, count(*) AS n FROM documents d JOIN p ON p.id = d.doc_id GROUP BY ALL)"


def held_out():
    """A part of the documents that the model doesn't learn from, by the first digit of a hash."""
    return F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1).isin("0", "1", "2")


def languages(table):
    return labelling.fit(table("documents").where(~held_out()).select("text", F.col("lang").alias("label")))


@over_files("e10_bayes_weights", f"WITH {LANGUAGES} SELECT * FROM m_w")
def _(spark, table):
    return languages(table).weights.select("word", F.inline("held")).select("label", "word", "weight")


def told(table):
    """Confusion counts over all documents, those that the model has seen and those that it hasn't."""
    told_by = languages(table).scored(F.col("text"))["label"]
    return table("documents").select(held_out().alias("held_out"), F.col("lang").alias("gold"), told_by.alias("pred")).groupBy("held_out", "gold", "pred").agg(F.count(F.lit(1)).alias("n"))


@over_files("e01_bayes_confusion", f"{TOLD} SELECT * FROM c")
def _(spark, table):
    return told(table)


@over_files(
    "e01_bayes_per_class",
    f"""{TOLD}, h AS (SELECT gold, pred, n FROM c WHERE held_out), k AS (SELECT DISTINCT unnest([gold, pred]) AS class FROM h),
s AS (SELECT class, CAST(coalesce((SELECT sum(n) FROM h WHERE gold = class), 0) AS BIGINT) AS support, CAST(coalesce((SELECT sum(n) FROM h WHERE gold = class AND pred = class), 0) AS BIGINT) AS hit, CAST(coalesce((SELECT sum(n) FROM h WHERE pred = class), 0) AS BIGINT) AS predicted FROM k),
r AS (SELECT *, CASE WHEN predicted > 0 THEN hit / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall FROM s)
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM r""",
)
def _(spark, table):
    return evaluate.per_class(told(table).where("held_out").select("gold", "pred", "n"))


@over_files("e03_bayes_agreement", f"{TOLD}, h AS (SELECT gold, pred, n FROM c WHERE held_out), a AS (SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(n) FILTER (gold = pred) AS BIGINT) AS agree FROM h), e AS (SELECT sum(CAST(g.n AS DOUBLE) * p.n) AS chance FROM (SELECT gold, sum(n) AS n FROM h GROUP BY 1) g JOIN (SELECT pred, sum(n) AS n FROM h GROUP BY 1) p ON g.gold = p.pred) SELECT n, agree, (agree / n - chance / (CAST(n AS DOUBLE) * n)) / (1 - chance / (CAST(n AS DOUBLE) * n)) AS kappa FROM a, e")
def _(spark, table):
    return evaluate.agreement(told(table).where("held_out").select("gold", "pred", "n")).select("n", "agree", "kappa")


TRUSTED = {task: "', '".join(names) for task, names in evaluate.TRUSTED.items()}
TAUGHT = "SELECT r.text_clean AS text, ar.{column} AS label FROM reviews r JOIN analyzed_reviews ar ON ar.review_id = r.id WHERE ar.model_used IN ('{models}') AND length(r.text_clean) >= 10 AND ar.{column} IS NOT NULL"
BY_RULES = "SELECT r.id, r.text_clean AS text FROM reviews r JOIN analyzed_reviews ar ON ar.review_id = r.id WHERE ar.model_used = 'rules' AND trim(r.text_clean) <> ''"
RELABELLED = f"""WITH {bayes_sql("f", TAUGHT.format(column="sentiment", models=TRUSTED["sentiment"]))},
{bayes_sql("a", TAUGHT.format(column="pain_point_category", models=TRUSTED["category"]))},
n AS (SELECT x.id, x.label AS sentiment, y.label AS category FROM ({predicted_sql("f", BY_RULES)}) x JOIN ({predicted_sql("a", BY_RULES)}) y ON x.id = y.id)
SELECT ar.review_id, coalesce(n.sentiment, ar.sentiment) AS sentiment, coalesce(n.category, ar.pain_point_category) AS pain_point_category,
  CASE WHEN n.id IS NULL THEN ar.severity WHEN n.sentiment = 'negative' AND n.category NOT IN {domain.NON_PROBLEM} THEN CASE r.rating WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END ELSE 'low' END AS severity,
  CASE WHEN n.id IS NULL THEN ar.model_used ELSE 'complement-bayes' END AS model_used
FROM analyzed_reviews ar JOIN reviews r ON r.id = ar.review_id LEFT JOIN n ON n.id = ar.review_id"""


@over_star("s08_relabel_by_model", RELABELLED)
def _(t):
    """Labels that the rules gave are written anew by a model trained on the trusted ones; the others stay."""
    models = {task: labelling.fit(evaluate.training_rows(t, task).select("text", "label")) for task in ("sentiment", "category")}
    ruled = t.reviews.join(t.analyzed.where("model_used = 'rules'").select(F.col("review_id").alias("id")), "id", "left_semi")
    fresh = labelling.tier(models["sentiment"], models["category"])(ruled).withColumn("keywords", F.array_join("keywords", "|"))
    return ingest.relabel(t.analyzed, fresh).select("review_id", "sentiment", "pain_point_category", "severity", "model_used")


GLUED = """WITH w AS (SELECT word, CAST(round(1000000 * ln(sum(count(*)) OVER () / count(*))) AS BIGINT) AS cost FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1),
g AS (SELECT DISTINCT replace(p_name, ' ', '') AS run FROM part),
e AS (SELECT run, pos, length(word) AS n, word, cost FROM g, w, unnest(range(1, 41)) AS t(pos) WHERE substr(run, pos, length(word)) = word),"""


@over_files(
    "x14_segmented_names",
    f"""{GLUED.replace("WITH w", "WITH RECURSIVE w")}
p AS (SELECT run, CAST(1 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS cost, CAST([] AS VARCHAR[]) AS said FROM g UNION ALL SELECT p.run, p.pos + e.n, p.cost + e.cost, list_append(p.said, e.word) FROM p JOIN e ON e.run = p.run AND e.pos = p.pos),
b AS (SELECT run, array_to_string(said, ' ') AS words FROM p WHERE pos = length(run) + 1 QUALIFY row_number() OVER (PARTITION BY run ORDER BY cost, len(said), list_transform(said, lambda s: -length(s))) = 1)
SELECT p_partkey, b.words FROM part JOIN b ON b.run = replace(p_name, ' ', '')""",
)
def _(spark, table):
    """Names without their spaces, cut by the costs of the words that names have; the SQL goes through all cuts."""
    parts = table("part")
    words = parts.select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()  # the words of names: few
    total = sum(r["n"] for r in words)
    counted = spark.createDataFrame([(r["word"], total / r["n"]) for r in words], "word string, odds double").select("word", labelling.whole(F.ln("odds")).alias("cost"))
    costs = {r["word"]: r["cost"] for r in counted.collect()}
    return parts.select("p_partkey", segmentation.spaced(F.replace("p_name", F.lit(" "), F.lit("")), costs, "[a-z]+").alias("words"))


@over_files("x14_fitted_words")
def _(spark, table):
    """Sentences of documents with their spaces taken out, cut by a lexicon that is fitted on them without a dictionary.

    For each document: its words and those found, and how many ends of words are right.
    """
    said = table("documents").select("doc_id", F.explode(F.split(F.lower("text"), r"[^\p{L} ]+")).alias("said"))
    said = said.select("doc_id", F.trim("said").alias("said")).where("said != ''")
    said = said.withColumn("said", F.when(F.contains("said", F.lit("  ")), F.regexp_replace("said", " +", " ")).otherwise(F.col("said")))
    rows = said.withColumn("glued", F.replace("said", F.lit(" "), F.lit("")))
    costs = segmentation.fit(segmentation.runs(rows, "glued", r"\p{L}+"), most_words=20_000, candidates=60_000, max_length=10, least=5, rounds=4)
    return segmentation.compared(said, costs, 10)
