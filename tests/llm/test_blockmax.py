"""Ranked search against plain scoring of all documents, and the blocks that a search leaves closed."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.llm import blockmax, queries

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def ranked(docs, items, k):
    """(item_id, rank, doc_id, score) by scoring every document."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, c in counted:
            m = 25 + (75 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, doc_id is None, doc_id))
        out += [(item_id, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


def test_terms_of_bytes():
    texts = ["", "Ab1 ünï-Ü_x\x00y", None, "a", "b", "[[", "É漢a'Z"]
    found, owner = blockmax.terms(pa.array(texts))
    assert [(t.decode(), o) for t, o in zip(found.to_pylist(), owner.tolist())] == [(t, i) for i, x in enumerate(texts) for t in terms(x)]
    assert blockmax.terms(pa.array([None, ""], pa.string()))[0].to_pylist() == []


@pytest.mark.parametrize("seed", range(4))
def test_packed_blocks(seed):
    pick = np.random.default_rng(seed)
    n = 700
    words = [f"w{int(x)}" for x in pick.zipf(1.3, 9000) % 900]
    owner = np.sort(pick.integers(0, n, len(words)))
    m = 25 + 3 * np.bincount(owner, minlength=n)
    made = blockmax.invert(pa.array([w.encode() for w in words], pa.large_binary()), owner, m, 5)
    shard = blockmax.Shard((n, np.arange(n, dtype="<i8").tobytes(), m.astype("<i8").tobytes() + bytes(n)))
    want = defaultdict(Counter)
    for w, o in zip(words, owner.tolist()):
        want[w][o] += 1
    assert made.num_rows == len(want)
    for r in made.to_pylist():
        shard.add(r["term"], r["blocks"], r["data"])
    shard.ready()
    for r in made.to_pylist():
        got = []
        for k in range(*shard.terms[r["term"]]):
            shard.open(np.array([k]))
            at, h = int(shard.place[k]), shard.heads[k]
            docs, impact = shard.doc[at : at + int(h["size"])], shard.impact[at : at + int(h["size"])]
            assert (docs[0], docs[-1], impact.max(), len(docs)) == (h["first"], h["last"], h["peak"], h["size"])
            got += list(zip(docs.tolist(), impact.tolist()))
        here = want[r["term"].decode()]
        assert r["df"] == len(here) and got == [(d, 1_000_000_000 * c // (1000 * c + 8 * int(m[d]))) for d, c in sorted(here.items())]


@pytest.mark.parametrize("at_once", [1, 64])
def test_search_skips_blocks(at_once):
    """A document that holds all rare terms sets a threshold that most blocks of common terms can't reach."""
    pick = random.Random(1)
    n = 20_000
    docs = [" ".join(pick.choice(["the", "of", "and", "to"]) for _ in range(6)) for _ in range(n)]
    docs[700] = "zebra quagga okapi the of and to"
    docs[9000] = docs[700]
    docs[15_000] = "zebra of"
    found, owner = blockmax.terms(pa.array(docs))
    total = len(owner)
    m = 25 + (75 * np.bincount(owner, minlength=n) * n) // total
    shard = blockmax.Shard((n, np.arange(n, dtype="<i8").tobytes(), m.astype("<i8").tobytes() + bytes(n)))
    df = {}
    for r in blockmax.invert(found, owner, m, 0).to_pylist():
        shard.add(r["term"], r["blocks"], r["data"])
        df[r["term"]] = r["df"]
    asked = [(t, math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))) for t in (b"the", b"of", b"and", b"zebra", b"quagga", b"okapi")]
    got, scores = shard.ready().search(asked, 0, 3, at_once)
    best = [d for _, d in sorted(zip((-scores).tolist(), got.tolist()))][:3]
    assert best == [700, 9000, 15_000]
    assert len(shard.is_open) > 400 and shard.is_open.sum() < 20


def test_odd_rows(spark, odd_docs):
    asked = [(1, "the QUICK brown dogs"), (2, None), (3, ""), (4, "a a a x"), (4, "ü 漢字"), (None, "world alone"), (5, "nowhere"), (6, "the quick brown fox jumps over the lazy dog")]
    items = spark.createDataFrame([(*x, "c", "c", "c") for x in asked], "item_id long, text string, term string, shard string, item string")
    postings, n, total = blockmax.index(odd_docs, shard_bytes=300)
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert (n, total) == (sum(bool(terms(t)) for _, t in docs), sum(len(terms(t)) for _, t in docs))
    want = ranked(docs, asked, 4)
    assert rows(blockmax.rank(postings, n, items, 4)) == want
    assert rows(blockmax.rank(postings, n, items, 4, block_terms=3)) == want


def test_empty_tables(spark, no_docs):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    postings, n, total = blockmax.index(no_docs)
    assert (n, total) == (0, 0) and blockmax.rank(postings, n, items).count() == 0
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    postings, n, _ = blockmax.index(docs)
    assert blockmax.rank(postings, n, items.limit(0)).count() == 0


def test_query(spark, small):
    read = lambda t, key: [(r[key], r["text"]) for r in spark.read.parquet(f"{small}/{t}.parquet").collect()]
    assert rows(queries.op13_rank(spark, small)) == ranked(read("documents", "doc_id"), read("benchmark", "item_id"), 10)
