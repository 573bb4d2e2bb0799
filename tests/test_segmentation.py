"""Segmentation against all cuts of short strings, expected counts against their sums, and a fit on glued words."""

import itertools
import math
import random
import time
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from tallyloom.functions import text as x
from tallyloom.operators import segmentation as s

from pyspark.sql import functions as F


def cuts(run):
    for marks in itertools.product([0, 1], repeat=max(0, len(run) - 1)):
        out, at = [], 0
        for i, m in enumerate(marks, 1):
            if m:
                out.append(run[at:i])
                at = i
        yield [*out, run[at:]]


def lexicons(seed):
    pick = random.Random(seed)
    words = {"".join(pick.choice("abก") for _ in range(pick.randint(1, 4))): pick.choice([1, 2, 3, 5]) * s.UNIT for _ in range(14)}
    return {**words, "a": 4 * s.UNIT}


def runs(seed):
    pick = random.Random(seed)
    return ["".join(pick.choice("abกz") for _ in range(pick.randint(0, 9))) for _ in range(40)]


@pytest.mark.parametrize("seed", range(5))
def test_least_cut(seed):
    costs = lexicons(seed)
    lexicon = s.Lexicon(costs)
    most = lexicon.max_length

    def key(cut):
        return sum(costs.get(w, s.UNKNOWN + len(w) * s.UNKNOWN_CHAR) for w in cut), len(cut), [-len(w) for w in cut]

    for run, got in zip(runs(seed), lexicon.segment(runs(seed))):
        assert got == (min((c for c in cuts(run) if max(map(len, c)) <= most), key=key) if run else [])


@pytest.mark.parametrize("seed", range(5))
def test_expected_counts(seed):
    costs = lexicons(seed) | {c: 3 * s.UNIT for c in "abกz"}
    lexicon = s.Lexicon(costs)
    counts = np.arange(1.0, 41.0)
    want = dict.fromkeys(costs, 0.0)
    for run, n in zip(runs(seed), counts):
        ways = [(math.exp(-sum(costs[w] for w in c) / s.UNIT), c) for c in cuts(run) if run and all(w in costs for w in c)]
        for p, c in ways:
            for w in c:
                want[w] += n * p / sum(q for q, _ in ways)
    got = dict(zip(lexicon.words, lexicon.expected(runs(seed), counts)))
    assert got == pytest.approx(want)


def test_fit_finds_words(spark):
    """No dictionary: words come back out of text in which they were glued together."""
    pick = random.Random(3)
    words = ["กาแฟ", "อร่อย", "ร้าน", "บริการ", "ช้า", "มาก", "แพง", "ที่จอด", "รถ", "สะอาด", "ห้อง", "น้ำ"]
    said = [[pick.choice(words) for _ in range(pick.randint(3, 9))] for _ in range(1500)]
    rows = spark.createDataFrame([(i, "".join(w)) for i, w in enumerate(said)], "id long, text string").repartition(5)
    costs = s.fit(s.runs(rows, "text"), most_words=200, candidates=3000, max_length=8)
    got = {r["id"]: r["t"].split(" ") for r in rows.select("id", s.spaced(F.col("text"), costs, max_length=8).alias("t")).collect()}

    def edges(w):
        return set(itertools.accumulate(map(len, w)))

    right = sum(len(edges(a) & edges(got[i])) for i, a in enumerate(said))
    assert right / sum(len(edges(w)) for w in got.values()) > 0.95
    assert right / sum(len(edges(w)) for w in said) > 0.95


def test_fit_is_free_of_layout(spark):
    rows = spark.createDataFrame([("กขคกข" * k, ) for k in range(1, 30)], "text string")
    a, b = (s.fit(s.runs(df, "text"), most_words=20, rounds=3) for df in (rows.repartition(1), rows.repartition(6)))
    assert a.keys() == b.keys() and max(abs(a[w] - b[w]) for w in a) <= 1


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "no Thai at all"), (4, "x กาแฟดีmenu"), (5, "กาแฟ" * 20_000)]
    costs = {"กาแฟ": 100, "ดี": 100}
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r["id"]: r["t"] for r in df.select("id", s.spaced(F.col("text"), costs).alias("t")).collect()}
    assert got == {1: None, 2: "", 3: "no Thai at all", 4: "x  กาแฟ ดี menu", 5: " ".join(["กาแฟ"] * 20_000)}
    assert s.fit(s.runs(df.limit(0), "text")) == {}
    assert s.Lexicon({}).segment(["กา"]) == [["ก", "า"]]


def test_keywords_of_unspaced_text(spark):
    df = spark.createDataFrame([("กาแฟดีมาก ร้าน",)], "text string")
    words = x.keywords(s.spaced(F.col("text"), {"กาแฟ": 100, "ดี": 100, "มาก": 100, "ร้าน": 100}))
    assert df.select(words.alias("k")).first()["k"] == ["กาแฟ", "ดี", "มาก", "ร้าน"]


def prose(seed, n):
    """Runs of words of few syllables, some of them long."""
    pick = random.Random(seed)
    words = ["".join(pick.choice(["an", "re", "tion", "ou", "è", "st", "the", "กา"]) for _ in range(pick.randint(1, 4))) for _ in range(60)]
    return ["".join(pick.choice(words) for _ in range(pick.choice([1, 4, 9, 30, 200]))) for _ in range(n)]


def substrings(texts, counts, max_length):
    held = Counter()
    for t, n in zip(texts, counts):
        for length in range(1, max_length + 1):
            for i in range(len(t) - length + 1):
                held[t[i : i + length]] += n
    return held


def test_counts_of_substrings():
    texts, counts = ["ab", "a", "", "abcab", "ก\U0001f600ก\U0001f600", *prose(1, 30)], np.arange(1, 36)
    whole = "".join(t + "\0" * 7 for t in texts)
    got = {whole[i : i + n]: c for n, at, held in s._counted(texts, counts, 7) for i, c in zip(at.tolist(), held.tolist())}
    assert got == substrings(texts, counts.tolist(), 7)


@pytest.mark.parametrize("blocks, most", [(1, 50), (6, 50), (6, 400), (40, 100), (3, 100_000)])
def test_seeds_are_those_of_all_substrings(spark, monkeypatch, blocks, most):
    """Blocks send only what is heavy in them; candidates and counts are still those of all substrings."""
    texts = sorted(set(prose(2, 300)))
    rows = spark.createDataFrame([(t, 1 + k % 4) for k, t in enumerate(texts)], "run string, n long").repartition(blocks).localCheckpoint()
    monkeypatch.setattr(s, "BLOCK", sum(map(len, texts)) // blocks)
    held = {w: n for w, n in substrings(texts, [1 + k % 4 for k in range(len(texts))], 6).items() if len(w) == 1 or n >= 3}
    want = sorted(held, key=lambda w: (len(w) > 1, -held[w] * len(w), w))[:most]
    got = s.seeds(rows, most, 6, 3)
    assert list(got) == want and all(got[w] == held[w] for w in want)


def test_seeds_of_unlike_blocks(spark, monkeypatch):
    """A substring that no block holds for heavy may be so in all of them together."""
    texts = [a * 3 + b + "xyz" + c for k, (a, b, c) in enumerate(itertools.product("abcdefgh", repeat=3))]
    rows = spark.createDataFrame([(t, 1) for t in texts], "run string, n long").repartitionByRange(8, "run").localCheckpoint()
    monkeypatch.setattr(s, "BLOCK", sum(map(len, texts)) // 8)
    held = {w: n for w, n in substrings(texts, [1] * len(texts), 5).items() if len(w) == 1 or n >= 2}
    assert list(s.seeds(rows, 40, 5, 2)) == sorted(held, key=lambda w: (len(w) > 1, -held[w] * len(w), w))[:40]


def test_a_block_sends_little():
    """All distinct substrings were sent before."""
    texts = prose(3, 2000)
    sent = sum(map(len, s._heavy(10, 300, None)(iter([pd.DataFrame({"run": texts, "n": 1})]))))
    assert sent * 10 < len(substrings(texts, [1] * len(texts), 10))


def lexicon_of(texts):
    held = substrings(texts, [1] * len(texts), 8)
    return s.Lexicon(s.costs_of({w: float(n) for w, n in held.items() if n > 20 or len(w) == 1}), 8)


def test_long_runs_in_stretches(monkeypatch):
    """Stretches give the sums and the cuts that whole runs give."""
    texts = prose(4, 40) + ["z" * 500, "é" + "an" * 300 + "?"]
    lexicon, counts = lexicon_of(texts[:-1]), np.arange(1.0, 43.0)
    monkeypatch.setattr(s, "LONG", 10_000)
    cuts_, sums = lexicon.segment(texts), lexicon.expected(texts, counts)
    monkeypatch.setattr(s, "LONG", 9)
    assert lexicon.segment(texts) == cuts_
    assert lexicon.expected(texts, counts) == pytest.approx(sums, rel=1e-9, abs=1e-9)


def test_long_runs_take_no_longer():
    """One long run is work for as many characters as short runs have; before, each of its places was a step of its own."""
    texts = [t[:50] for t in prose(5, 3000)]
    long = ["".join(texts)]
    lexicon = lexicon_of(texts[:500])

    def least(runs):
        took = []
        for _ in range(3):
            start = time.perf_counter()
            lexicon.expected(runs, np.ones(len(runs)))
            lexicon.segment(runs)
            took.append(time.perf_counter() - start)
        return min(took)

    assert least(long) < 15 * least(texts)


def test_large_alphabets(monkeypatch):
    """Trees that are searched give what indexed ones give."""
    texts = prose(6, 30)
    want = lexicon_of(texts).segment(texts)
    monkeypatch.setattr(s, "DENSE", 0)
    assert lexicon_of(texts).segment(texts) == want


def test_compared(spark):
    rows = [(1, "an ana"), (1, "na an"), (None, "ก an"), (None, "xan"), (3, "a"), (4, "an " * 400 + "an")]
    costs = {"an": 100, "a": 300, "n": 300, "ก": 200}
    got = {r["doc_id"]: tuple(r)[1:] for r in s.compared(spark.createDataFrame(rows, "doc_id int, said string").repartition(3), costs).collect()}
    want = {}
    for k, said in rows:
        found, words = s.Lexicon(costs).segment([said.replace(" ", "")])[0], said.split(" ")
        a, b = (set(itertools.accumulate(map(len, w))) for w in (words, found))
        want[k] = tuple(x + y for x, y in zip(want.get(k, (0, 0, 0)), (len(words), len(found), len(a & b))))
    assert got == want
