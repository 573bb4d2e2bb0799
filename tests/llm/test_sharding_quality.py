import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tallyloom.llm import quality, sharding


def test_shards(spark, docs, odd_docs, no_docs):
    grown = docs.unionByName(docs.select((F.col("doc_id") + 1_000_000).alias("doc_id"), F.concat("text", F.col("doc_id").cast("string")).alias("text"), "lang", "source", "n_chars"))
    rows = sharding.shard(grown, group="text", row_id="doc_id", n_shards=16, part_bytes=10_000).select("doc_id", "text", "size", "shard", "slot").collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in grown.select("doc_id", "text").collect())
    by, where = defaultdict(list), defaultdict(set)
    for r in rows:
        assert r["size"] == len((r["text"] or "").encode()) + 1
        by[r["shard"]].append(r)
        where[r["text"]].add(r["shard"])
    total = sum(r["size"] for r in rows)
    largest = max(r["size"] for r in rows)
    for shard in by.values():
        assert sorted(r["slot"] for r in shard) == list(range(len(shard)))
        assert abs(sum(r["size"] for r in shard) - total / 16) <= 0.002 * total / 16 + largest
    assert set(by) == set(range(16))
    assert all(len(s) == 1 for s in where.values())
    odd = sharding.shard(odd_docs, group="text", row_id="doc_id", n_shards=16).collect()
    assert len(odd) == odd_docs.count() and {r["shard"] for r in odd} <= set(range(16))
    assert sharding.shard(no_docs, group="text", row_id="doc_id").count() == 0


def test_hot_group_is_cut(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    sums = [r["s"] for r in sharding.shard(rows, "text", "doc_id", 16).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sums) == 16 and max(sums) - min(sums) < 0.01 * sum(sums) / 16 + 20


def test_names_that_clash(spark):
    names = ["Size", "SHARD", "row", "a", "b", "at", "part", "place", "interval", "_hs_a", "a.b", "we`ird"]
    odd = spark.createDataFrame([(1, "x", *names), (2, None, *names)], "doc_id long, text string, " + ", ".join(f"`{n.replace('`', '``')}` string" for n in names))
    got = sharding.shard(odd, "text", "doc_id", 2)
    assert got.columns == ["doc_id", "text", *names[2:], "size", "shard", "slot"]
    assert {(r["doc_id"], r["size"], r["interval"]) for r in got.collect()} == {(1, 2, "interval"), (2, 1, "interval")}


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    t = text or ""
    words = WORD.findall(t)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            covered |= set(range(i, i + 8))
    lines, seen, dup = t.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_ledger(docs, odd_docs, no_docs):
    for table in (docs, odd_docs):
        want = Counter((r["doc_id"], measured(r["text"])) for r in table.select("doc_id", "text").collect())
        book = quality.ledger(table)
        got = Counter((r["doc_id"], (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])) for r in book.collect())
        assert got == want
    assert quality.ledger(no_docs).count() == 0


def test_policies_and_ablations(docs):
    book = quality.written(docs)
    rows = book.collect()
    for a in quality.ablations(book, "v1").collect():
        bit = quality.BIT[a["rule"]]
        assert a["n_failed"] == sum(r["fail_bits"] & bit > 0 for r in rows)
        assert a["n_only"] == sum(r["fail_bits"] == bit for r in rows)
        kept = book.where(quality.passes("v1", without=a["rule"])).count()
        assert kept == book.where(quality.passes("v1")).count() + a["n_only"]
