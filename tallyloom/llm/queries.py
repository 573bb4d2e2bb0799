"""The numbered operators applied to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import packing

    packed = packing.pack(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import sharding

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    dealt = sharding.shard(docs, group="text", row_id="doc_id", n_shards=16)
    crc = F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0).cast("long"))
    return dealt.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import minhash

    return minhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_class")


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import wavelet

    folder, manifest = wavelet.write_files(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=2)
    return wavelet.read_files(folder, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import quality

    book = quality.ledger(_table(spark, sf_dir, "documents"))
    base_failed = ~quality.passes("base")
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), quality.passes("v1").alias("kept"), "n_upper", "n_lines", "fail_bits"
    )


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import html_text

    return html_text.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import decontaminate

    found = decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.lit(True).alias("contaminated"), "coverage", "item_words", F.size("tiles").alias("n_tiles"), F.array_max("tiles.length").alias("longest_tile"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import secrets

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find(docs, secrets.train(docs))
    base = F.filter("spans", lambda s: s["kind"] < secrets.KINDS.index("random"))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"), of(3).alias("n_random")
    )


def held_out(doc_id: str = "doc_id"):
    """Rows that no model learns from: a fifth of all, by a checksum of the id."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import toxicity

    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").where(~held_out()))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "best", "expected", F.size("passages").alias("n_passages"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import substrings

    done = substrings.deduplicate(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import common, warc

    folder = warc.write(_table(spark, sf_dir, "pages"))
    found = common.stored(warc.read(spark, folder, payloads=False), "warc-records")
    return warc.resolve(found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "n_segments", "error")


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import negatives

    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    rows, quantiser = negatives.index(negatives.integers(vectors))
    return negatives.mine(rows, quantiser, rows.where("id % 100 = 0"))


def op13_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import blockmax

    postings, n, _ = blockmax.index(_table(spark, sf_dir, "documents"))
    return blockmax.rank(postings, n, _table(spark, sf_dir, "benchmark"), k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack": op1_pack,
    "op2_shards": op2_shards,
    "op3_minhash": op3_minhash,
    "op4_tokens": op4_tokens,
    "op5_quality": op5_quality,
    "op6_main_text": op6_main_text,
    "op7_decontaminate": op7_decontaminate,
    "op8_secrets": op8_secrets,
    "op9_toxicity": op9_toxicity,
    "op10_substrings": op10_substrings,
    "op11_warc": op11_warc,
    "op12_negatives": op12_negatives,
    "op13_rank": op13_rank,
}

#: Where SQL can't tell an operator's rows it is tested against brute force.
QUALITY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
i AS (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8),
x AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(words[i : i + 7], ' ')) AS c FROM i),
y AS (SELECT rid, least(8, i - coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -8)) AS n FROM x WHERE c > 1),
r AS (SELECT rid, CAST(sum(n) AS BIGINT) AS n_repeat_words FROM y GROUP BY 1),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper,
  CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (5 * n_symbols > n_words)::INT + 8 * (2 * n_upper > word_chars)::INT + 16 * (2 * n_dup_lines > n_lines)::INT + 32 * (word_chars > 40 * n_words)::INT AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, n_upper, n_lines, fail_bits FROM b
"""

#: Base32 by groups of five hexadecimal digits, four characters each; a block longer than 16,384 bytes is cut.
WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS hex, min(page_id) OVER (PARTITION BY sha256(b)) AS first FROM p),
n AS (SELECT *, [CAST('0x' || substr(hex, i, 5) AS INT) for i in [1, 6, 11, 16, 21, 26, 31, 36]] AS g FROM d),
s AS (SELECT *, 87 + payload_bytes + payload_bytes // 4096 * 8 + CASE WHEN payload_bytes % 4096 > 0 THEN 4 + length(printf('%x', payload_bytes % 4096)) ELSE 0 END + 5 AS block FROM n)
SELECT page_id, payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 15) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 10) % 32 + 1, 1)
  || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 5) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v % 32 + 1, 1) for v in g], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to,
  CASE WHEN page_id <> first THEN 1 ELSE CAST(ceil(block / 16384) AS INT) END AS n_segments, CAST(NULL AS VARCHAR) AS error FROM s
"""

NEGATIVES_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, e.vec_id AS other, a.label = e.label AS same, CAST(list_inner_product(a.v, e.v) AS BIGINT) AS score FROM e AS a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INT) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5
"""

RANK_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
g AS (SELECT count(DISTINCT rid) AS n, count(*) AS l FROM d),
m AS (SELECT rid, 25 + (75 * count(*) * (SELECT n FROM g)) // (SELECT l FROM g) AS m FROM d GROUP BY 1),
p AS (SELECT rid, doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * (SELECT n FROM g) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p GROUP BY 1),
s AS (SELECT item_id, rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (rid) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, rid) AS INT) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
"""

ORACLE_SQL: dict[str, str] = {"op5_quality": QUALITY_SQL, "op11_warc": WARC_SQL, "op12_negatives": NEGATIVES_SQL, "op13_rank": RANK_SQL}
