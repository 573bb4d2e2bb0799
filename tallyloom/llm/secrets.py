"""Secret spans by patterns and character Markov models (operator 8).

Base spans come from three fixed patterns.  The method adds long runs of key-like
characters that a first-order character model of random strings explains better than
one of ordinary identifiers: the sum of log-likelihood ratios of the character pairs
must exceed ``threshold``, and its mean ``mean``, so that a long ordinary run doesn't come in
by its length.  Both models are trained here from labelled samples: random strings are
encoded digests of numbers; ordinary ones are dates, times and serials of numbers, and
words, identifiers, slugs and paths of the words, of a sample of about ``sample_docs`` distinct texts chosen by
their hashes, so neither the order nor the partitions of rows change a model.

Only functions inside the JVM are used.  Matches are found by surrounding each with a
mark that no text holds (a mark in the text is first replaced by another character of
the same length that no pattern takes), cutting there and adding up lengths; so
positions are code points, as in ``length``.

Defined results: a null or empty text has no spans; very long texts are searched
whole; repeated rows give repeated rows; other columns are not read and ``cover`` keeps
them whatever their names; an empty table gives no rows (and untrained, uniform models).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.llm import common

MARK, STAND_IN = "\ue000", "\u00bf"
#: Kinds in the order of the report.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: Runs are whole, so a minimal length in the pattern drops the same matches as a later test.
PATTERNS = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}", "random": "[A-Za-z0-9+/_=-]{20,}"}
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SPAN = "struct<start:int,kind:int,stop:int>"


def let(value: Column, build) -> Column:
    """``build(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), build), 0)


def _matches(text: str, kind: str, keep) -> Column:
    """Spans of a pattern, with what ``keep`` says of the matching string."""
    pattern = PATTERNS[kind]
    parts = F.split(F.regexp_replace(text, pattern, MARK + "$0" + MARK), MARK)
    number = KINDS.index(kind)
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.array().cast(f"array<{SPAN}>").alias("found"))

    def step(s: Column, part: Column) -> Column:
        end = s["at"] + F.length(part)
        one = F.struct(s["at"].alias("start"), F.lit(number).alias("kind"), end.alias("stop"))
        return F.struct(end.alias("at"), (~s["inside"]).alias("inside"), F.when(s["inside"] & keep(part), F.concat(s["found"], F.array(one))).otherwise(s["found"]).alias("found"))

    return F.when(F.col(text).rlike(pattern), F.aggregate(parts, start, step, lambda s: s["found"])).otherwise(F.array().cast(f"array<{SPAN}>"))


class MarkovModels:
    """Log-likelihood ratios of character pairs, random against ordinary."""

    def __init__(self, ratios: list[float]):
        self.ratios = ratios

    def score(self, text: Column) -> Column:
        """Sum of ratios over a string of the alphabet's characters."""
        table, size = F.lit(self.ratios), len(ALPHABET)
        place = lambda i: F.instr(F.lit(ALPHABET), F.substring(text, i, F.lit(1))) - 1
        return F.aggregate(F.sequence(F.lit(1), F.length(text) - 1), F.lit(0.0), lambda s, i: s + F.get(table, (place(i) * size + place(i + 1)).cast("int")))


def _pairs(strings: DataFrame, label: int) -> DataFrame:
    """Counts of character pairs in column ``s``."""
    long = strings.where(F.length("s") >= 2)
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substring("s", i, F.lit(2)))).alias("pair")
    return long.select(pair).groupBy("pair").agg(F.count(F.lit(1)).alias("n")).withColumn("label", F.lit(label))


def _numbered() -> Column:
    """Dates, times, serials and file names that are made of a number ``id``."""
    digits = lambda n, width: F.lpad((F.abs(F.xxhash64(F.lit(n), "id")) % 10**width).cast("string"), width, "0")
    day = F.date_add(F.lit("1980-01-01").cast("date"), (F.col("id") * 7919 % 20_000).cast("int"))
    at = lambda form: F.date_format(day, form)
    clock = F.concat_ws("/", F.lpad((F.col("id") % 24).cast("string"), 2, "0"), F.lpad((F.col("id") % 60).cast("string"), 2, "0"), F.lpad((F.col("id") % 59).cast("string"), 2, "0"))
    return F.array(
        F.concat_ws("T", at("yyyy-MM-dd"), clock),
        F.concat(at("yyyy-MM-dd"), F.lit("T"), F.replace(clock, F.lit("/"), F.lit("-")), F.lit("Z")),
        F.concat_ws("-", at("yyyyMMdd"), digits(1, 6)),
        F.concat(at("yyyy/MM/dd"), F.lit("/IMG_"), digits(2, 4)),
        F.concat(F.lit("INV"), at("yyyy"), F.lit("/"), digits(3, 4), F.lit("/"), digits(4, 10)),
        F.concat(F.lit("C"), digits(5, 8), F.lit("-"), digits(6, 4)),
        F.concat(F.lit("SN"), digits(7, 12)),
        F.concat_ws("-", digits(8, 3), digits(9, 4), digits(10, 4), digits(11, 4)),
        F.concat(F.lit("+"), digits(12, 12)),
    )


def labelled_samples(docs: DataFrame, sample_docs: int, random_strings: int) -> tuple[DataFrame, DataFrame]:
    """(random, ordinary) strings, each in column ``s``."""
    spark: SparkSession = docs.sparkSession
    digest = F.sha2(F.col("id").cast("string"), 256)
    numbers = spark.range(random_strings)
    random = numbers.select(F.explode(F.array(F.base64(F.unhex(digest)), F.substring(digest, 1, 40), F.md5(F.col("id").cast("string")), F.translate(F.base64(F.unhex(digest)), "+/", "-_"))).alias("s"))
    total = docs.count()
    least = max(1, math.ceil((1 << 20) * min(1.0, sample_docs / max(1, total))))
    # Equal texts count once, so a text that a third of all rows repeat is one text of the sample.
    sample = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.lit(least)).distinct()
    words = sample.select(F.filter(F.split("text", "[^A-Za-z]+"), lambda w: F.length(w) >= 2).alias("w")).where(F.size("w") >= 2)
    joined = F.transform("w", lambda w, i: F.concat(w, F.element_at(F.array(F.lit("_"), F.lit("-"), F.lit("/"), F.lit("")), (i % 4 + 1).cast("int")), F.when(i % 4 == 3, F.initcap(F.coalesce(F.get("w", i + 1), w))).otherwise(F.coalesce(F.get("w", i + 1), w))))
    # Counted identifiers (item_12, v2) are ordinary too.
    counted = F.transform("w", lambda w, i: F.concat(w, F.lit("_"), i.cast("string")))
    # Slugs of four words, the same as one word of capitals, and paths with a day and a number in them.
    few = lambda i: F.filter(F.slice("w", i + 1, 4), lambda w: w != "")
    slugs = F.transform("w", lambda w, i: F.concat_ws("-", F.array_join(few(i), "-"), (i % 20).cast("string")))
    humps = F.transform("w", lambda w, i: F.concat(w, F.array_join(F.transform(few(i), F.initcap), ""), F.when(i % 2 == 0, F.lit("V")).otherwise(""), (i % 10).cast("string")))
    paths = F.transform("w", lambda w, i: F.concat_ws("/", w, (1990 + i % 40).cast("string"), F.lpad((i % 12 + 1).cast("string"), 2, "0"), F.lpad((i % 28 + 1).cast("string"), 2, "0"), F.array_join(few(i), "_")))
    ordinary = words.select(F.explode(F.concat("w", joined, counted, slugs, humps, paths)).alias("s"))
    return random, ordinary.unionByName(numbers.select(F.explode(_numbered()).alias("s")))


def train(docs: DataFrame, sample_docs: int = 2000, random_strings: int = 4000, prior: float = 0.5) -> MarkovModels:
    random, ordinary = labelled_samples(docs, sample_docs, random_strings)
    size = len(ALPHABET)
    counts = [[[prior] * size for _ in range(size)] for _ in range(2)]
    # At most two rows for each pair of the alphabet pass to the driver.
    known = F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$")
    for r in _pairs(random, 1).where(known).unionByName(_pairs(ordinary, 0).where(known)).collect():
        counts[r["label"]][ALPHABET.index(r["pair"][0])][ALPHABET.index(r["pair"][1])] += r["n"]
    ratios = []
    for i in range(size):
        sums = [sum(counts[k][i]) for k in range(2)]
        ratios += [math.log(counts[1][i][j] / sums[1]) - math.log(counts[0][i][j] / sums[0]) for j in range(size)]
    return MarkovModels(ratios)


def _spans(rows: DataFrame, models: MarkovModels, threshold: float, mean: float) -> DataFrame:
    """``rows`` (row, text) with ``spans``."""
    safe = rows.select("row", "text", F.translate(F.coalesce("text", F.lit("")), MARK, STAND_IN).alias("safe"))
    value = lambda s: F.length(F.regexp_extract(s, ASSIGN, 2)) >= 6
    always = lambda s: F.lit(True)
    random = lambda s: s.rlike("[0-9]") & s.rlike("[A-Za-z]") & let(models.score(s), lambda x: (x > threshold) & (x > mean * (F.length(s) - 1)))
    found = safe.select("row", "text", F.concat(_matches("safe", "assign", value), _matches("safe", "access", always), _matches("safe", "hex", always)).alias("base"), _matches("safe", "random", random).alias("more"))
    own = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] <= m["start"]) & (m["stop"] <= b["stop"])))
    return found.select("row", "text", F.array_sort(F.concat("base", own)).alias("spans"))


def find(docs: DataFrame, models: MarkovModels, threshold: float = 12.0, mean: float = 0.7) -> DataFrame:
    """doc_id, text and ``spans``: array of (start, kind, stop) in order of start, then kind.

    A random run counts only if it has a letter and a digit and does not lie within one base
    span; one that reaches beyond a base span is reported whole beside it.
    """
    rows = docs.select(F.col("doc_id").alias("row"), "text")
    return _spans(rows, models, threshold, mean).select(F.col("row").alias("doc_id"), "text", "spans")


def cover(docs: DataFrame, models: MarkovModels, threshold: float = 12.0, mean: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, with every span of ``text`` masked."""
    # The whole input row travels as one column, so its names meet no others.
    found = _spans(docs.select(common.whole_row(docs).alias("row"), "text"), models, threshold, mean)
    text = masked(F.col("text"), F.col("spans"))
    return found.select(*(text.alias("text") if c.lower() == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def joined(spans: Column) -> Column:
    """Spans as ``kind:start:stop``, comma-joined."""
    names = F.lit(list(KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def masked(text: Column, spans: Column, cover: str = "[SECRET]") -> Column:
    """The text with every span, or run of overlapping ones, covered."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fresh = F.concat(s["out"], F.substring(text, s["at"] + 1, F.greatest(x["start"] - s["at"], F.lit(0))), F.lit(cover))
        return F.struct(F.greatest(s["at"], x["stop"]).alias("at"), F.when(x["start"] >= s["at"], fresh).otherwise(s["out"]).alias("out"))

    tail = lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, tail))
