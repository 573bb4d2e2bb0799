"""Quality rules as a bitmask ledger (operator 5).

One scan evaluates every rule once and keeps, per document, the measurements and a
long whose bit ``i`` says that rule ``i`` failed.  A policy is a version and a mask of
rules; its verdict, and the verdict without any one rule, are bit operations on the
ledger, so no text is read again.  Write the ledger before policies filter it
(:func:`written`): a filter on its plan would be pushed into the measurements.

All of it is array and string functions inside the JVM; no row leaves its partition.

Defined results: a null text has no words; empty and blank texts have none either;
very long texts are measured whole; repeated rows give repeated rows; other columns
are not read; an empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.llm import common

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words in a window, for repeats inside a text.
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    name: str
    #: SQL over the measurements; true where the rule fails.
    fails: str


#: Bits of the ledger, in this order; new rules go to the end.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "5 * n_symbols > n_words"),
    Rule("capitals", "2 * n_upper > word_chars"),
    Rule("duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule("word_length", "word_chars > 40 * n_words"),
)
BIT = {r.name: 1 << i for i, r in enumerate(RULES)}
#: Versioned policies: the rules that reject.
POLICIES = {
    "base": BIT["few_words"] | BIT["repeated_words"],
    "v1": sum(BIT.values()),
}


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of ``text``."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    base = base.select("doc_id", "t", F.btrim("t", F.lit(BLANKS)).alias("core"), F.split("t", "\n").alias("raw_lines"))
    base = base.select(
        "doc_id",
        "t",
        F.when(F.col("core") == "", F.array().cast("array<string>")).otherwise(F.split("core", "[\\x20\\x09-\\x0D]+")).alias("words"),
        F.filter("raw_lines", lambda x: F.btrim(x, F.lit(BLANKS)) != "").alias("lines"),
    )
    base = base.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        _without(F.col("t"), BLANKS).cast("long").alias("word_chars"),
        (F.length("t") - _without(F.col("t"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.length("t") - _without(F.col("t"), UPPER)).cast("long").alias("n_upper"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    # Each array is named twice where it is used, so that its projection stays apart and it is built once.
    kept = ("doc_id", "n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines")
    windows = F.when(
        F.size("hashes") > WINDOW, F.transform(F.sequence(F.lit(1), F.size("hashes") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("hashes", i, WINDOW)))
    ).otherwise(F.array().cast("array<long>"))
    base = base.select(*kept, windows.alias("windows"))
    ordered = F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"), F.array_sort(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
    ).otherwise(F.array().cast("array<struct<h:long,at:int>>"))
    base = base.select(*kept, ordered.alias("ordered"))
    item = lambda k: F.get("ordered", k)
    twice = F.when(
        F.size("ordered") > 0,
        F.filter(F.sequence(F.lit(0), F.size("ordered") - 1), lambda k: F.coalesce(item(k)["h"] == item(k - 1)["h"], F.lit(False)) | F.coalesce(item(k)["h"] == item(k + 1)["h"], F.lit(False))),
    ).otherwise(F.array().cast("array<int>"))
    base = base.select(*kept, "ordered", twice.alias("twice"))
    places = F.array_sort(F.transform("twice", lambda k: item(k)["at"]))
    base = base.select(*kept, places.alias("places"), F.size("twice").alias("n_twice"), F.size("ordered").alias("n_ordered"))
    covered = F.aggregate(
        "places", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda s, p: F.struct((s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n"), p.alias("last")), lambda s: s["n"]
    )
    return base.select(*kept, covered.cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and ``fail_bits`` of every document."""
    bits = sum((F.when(F.expr(r.fails), F.lit(BIT[r.name])).otherwise(F.lit(0)) for r in RULES), F.lit(0)).cast("long")
    return measure(docs).withColumn("fail_bits", bits)


def written(docs: DataFrame) -> DataFrame:
    """The ledger as a table in the shared folder."""
    return common.stored(ledger(docs), "ledger")


def passes(policy: str, without: str | None = None) -> Column:
    """Verdict of a policy on a ledger, if wanted without one of its rules."""
    return F.col("fail_bits").bitwiseAND(POLICIES[policy] & ~BIT.get(without, 0)) == 0


def ablations(book: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that only it rejects."""
    mask = POLICIES[policy]
    mine = [r.name for r in RULES if BIT[r.name] & mask]
    # At most 2^rules rows.
    grouped = book.groupBy(F.col("fail_bits").bitwiseAND(mask).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("rule"), F.lit(BIT[m]).cast("long").alias("bit")) for m in mine))).alias("r")
    rows = grouped.select("bits", "n", pairs).select("bits", "n", "r.rule", "r.bit")
    return rows.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )
