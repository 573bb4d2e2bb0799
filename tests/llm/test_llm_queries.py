"""The registered queries: what they derive from their operators, against plain Python over the same rows."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from test_duplicates import classes, removed
from test_scans import base_spans

from tallyloom.llm import queries


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def crc(text):
    return zlib.crc32((text or "").encode())


def collected(spark, small, name):
    return queries.QUERIES[name](spark, small).collect()


def test_op1(spark, small, rows):
    got = collected(spark, small, "op1_pack")
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append(r)
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert {r["doc_id"] for r in got} == {i for i, _ in rows}


def test_op2(spark, small, rows):
    got = collected(spark, small, "op2_shards")
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, crc(t)) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op3(spark, small, rows):
    got = collected(spark, small, "op3_minhash")
    assert Counter((r["doc_id"], r["class_id"], r["n_class"]) for r in got) == classes(rows)


def test_op4(spark, small, rows):
    got = {r["doc_id"]: r for r in collected(spark, small, "op4_tokens")}
    from tokenizers import Tokenizer

    tokenizer, start = Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json")), 0
    tokenizer.encode_special_tokens = True
    for i, t in sorted(rows):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        packed = b"".join(x.to_bytes(4, "little") for x in ids)
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(packed))
        start += len(ids)


def test_op5(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    found = con.execute(queries.ORACLE_SQL["op5_quality"])
    names = sorted(c[0] for c in found.description)
    want = Counter(tuple(dict(zip((c[0] for c in found.description), r))[n] for n in names) for r in found.fetchall())
    assert Counter(tuple(r[n] for n in names) for r in collected(spark, small, "op5_quality")) == want


def test_op6(spark, small):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = collected(spark, small, "op6_main_text")
    assert len(got) == len(pages)
    for r in got:
        assert r["url"] == pages[r["page_id"]]["url"] and r["n_chars"] == len(r["text"])
        assert r["text"] == "\n".join(" ".join(line.split()) for line in r["text"].split("\n"))


def test_op7(spark, small):
    got = collected(spark, small, "op7_decontaminate")
    assert got
    for r in got:
        assert r["contaminated"] and 0.5 <= r["coverage"] <= 1 and r["n_tiles"] >= 1 and r["longest_tile"] <= r["item_words"]


def test_op8(spark, small, rows):
    got = {r["doc_id"]: r for r in collected(spark, small, "op8_secrets")}
    names = ("assign", "access", "hex")
    for i, t in rows:
        spans = base_spans(t)
        said = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
        r = got[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == n for _, k, _ in spans) for n in range(3))
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith("random:")] == [s for s in said.split(",") if s]


def test_op9(spark, small, rows):
    got = collected(spark, small, "op9_toxicity")
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in rows)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_op10(spark, small, rows):
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in collected(spark, small, "op10_substrings"))
    assert got == removed(rows, 200)


@pytest.mark.parametrize("name", sorted(set(queries.ORACLE_SQL) - {"op5_quality"}))
def test_same_as_sql(spark, small, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    found = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    got = queries.QUERIES[name](spark, small)
    assert sorted(names) == sorted(got.columns)
    assert Counter(tuple(r[n] for n in names) for r in got.collect()) == Counter(found.fetchall())
