"""A corpus pipeline of five training-data operators.

Every stage works on all that the one before kept.  Between stages the rows are written
as Parquet to the folder the cluster shares and read again, so a lost executor costs
no more than a stage; a stage's table is deleted once the next one is written.

For all stages: a null text counts as an empty one, very long texts are read whole, an
empty table gives no rows, and columns of any name stay, whatever the operators call theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.llm import common, decontaminate, minhash, packing, queries, secrets, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; the model never sees held-out labels.

    Null, empty and wordless texts score as neutral ones and stay; rows that repeat stay or
    go together; a tie at one half goes; without labels nothing goes.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~queries.held_out())
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each class of near-duplicates.

    Null texts are one class, texts without words one for each text; a document without id
    stays only where its class has no other; of rows that repeat id and text one stays.
    """
    return minhash.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item by half.

    Null and empty texts cover none; rows that repeat stay or go together; a benchmark
    without rows or words leaves all.
    """
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets covered and n_chars counted anew.

    A null text stays null, its n_chars too; spans that overlap are covered as one.
    """
    covered = secrets.cover(docs, secrets.train(docs))
    return covered.withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids.

    A null or empty text is one end token; rows that repeat are packed each.
    """
    return packing.pack(docs, queries.tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: No stage but the last can be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = []
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.forget(*before)
        before = [docs]
    return docs
