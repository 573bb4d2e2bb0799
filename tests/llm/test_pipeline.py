"""The pipeline stage by stage, each against what its input alone says."""

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from test_duplicates import classes
from tallyloom.llm import common, decontaminate, packing, queries, secrets, toxicity


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "secrets", "packing"]
    kept = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before = now
        now = common.stored(stage(spark, before, small), name)
        kept[name] = (before, now)
        if name != "packing":
            assert now.columns == docs.columns
            assert set(r["doc_id"] for r in now.collect()) <= set(r["doc_id"] for r in before.collect())
    before, after = kept["toxicity"]
    model = toxicity.fit(before, spark.read.parquet(f"{small}/labels.parquet").where(~queries.held_out()))
    assert after.count() == toxicity.score(before, model).where("score < 0.5").count()
    before, after = kept["near_dedup"]
    groups = classes([(r["doc_id"], r["text"]) for r in before.collect()])
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({least for _, least, _ in groups})
    before, after = kept["decontamination"]
    hits = {r["doc_id"] for r in decontaminate.contaminated(before, spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()} - hits
    before, after = kept["secrets"]
    assert after.count() == before.count()
    models = secrets.train(before)
    clean = {r["doc_id"] for r in secrets.find(before, models).where("size(spans) = 0").collect()}
    text = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        assert r["n_chars"] == len(r["text"])
        assert (r["text"] == text[r["doc_id"]]) == (r["doc_id"] in clean)
    before, after = kept["packing"]
    want = packing.pack(before, queries.tokenizer_file("byte_bpe_50k.json"))
    key = lambda df: Counter((r["doc_id"], r["piece"], bytes(r["ids"])) for r in df.collect())
    assert key(after) == key(want)
    assert corpus_pipeline.run(spark, small).count() == after.count()


def test_odd_rows(spark, odd_docs, no_docs, small):
    """All stages on odd rows: nothing toxic or contaminated there, copies go, and every text is packed."""
    plain = odd_docs.select("doc_id", "text", "lang", "source", "n_chars", "size", "node", "score").withColumns({"a.b": F.lit("x"), "we`ird": F.lit("y"), "TEXT2": F.lit("z")})
    named = {n: stage for n, stage in corpus_pipeline.STAGES}
    now = common.stored(named["toxicity"](spark, plain, small), "odd")
    assert Counter(map(tuple, now.collect())) == Counter(map(tuple, plain.collect()))
    rows = [(r["doc_id"], r["text"]) for r in now.collect()]
    now = common.stored(named["near_dedup"](spark, now, small), "odd")
    groups = {(least, n) for _, least, n in classes(rows)}
    assert now.columns == plain.columns and now.count() >= len(groups)
    left = [(r["doc_id"], r["text"]) for r in now.collect()]
    assert all(n == 1 for _, _, n in classes(left))
    now = common.stored(named["decontamination"](spark, now, small), "odd")
    assert Counter((r["doc_id"], r["text"]) for r in now.collect()) == Counter(left)
    now = common.stored(named["secrets"](spark, now, small), "odd")
    assert Counter((r["doc_id"], r["text"]) for r in now.collect()) == Counter(left)
    packed = common.stored(named["packing"](spark, now, small), "odd")
    assert Counter(r["doc_id"] for r in packed.where("piece = 0").collect()) == Counter(i for i, _ in left)


def test_no_rows(spark, no_docs, small):
    table = no_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        table = common.stored(stage(spark, table, small), name)
        assert table.count() == 0
