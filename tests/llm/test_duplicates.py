import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallyloom.llm import components, minhash, sais, substrings


def shingle_set(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None


def classes(rows, least=0.8):
    """Brute force: least id of each component of pairs that are similar enough."""
    sets = [shingle_set(t) if shingle_set(t) else ("only", t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            alike = a == b if isinstance(a, tuple) or isinstance(b, tuple) else len(a & b) >= least * len(a | b)
            if alike:
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return Counter((rows[i][0], min((x for x in groups[find(i)] if x is not None), default=None), len(groups[find(i)])) for i in range(len(rows)))


def test_classes(docs, odd_docs, no_docs):
    for table in (docs, odd_docs):
        rows = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
        got = Counter((r["doc_id"], r["class_id"], r["n_class"]) for r in minhash.near_duplicates(table).collect())
        assert got == classes(rows)
    assert minhash.near_duplicates(no_docs).count() == 0


def test_group_of_near_copies(spark):
    random.seed(5)
    base = [f"w{random.randint(0, 9999)}" for _ in range(150)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(random.choice([0, 1, 2, 4, 8, 15])):
            words[random.randrange(150)] = f"e{random.randint(0, 9)}"
        rows.append((i, " ".join(words)))
    got = Counter((r["doc_id"], r["class_id"], r["n_class"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == classes(rows)


def test_pairs_whose_repeats_differ(spark):
    """Similar as sets, while one text or each repeats passages that the other has once or not at all."""
    random.seed(6)
    word = lambda: f"w{random.randint(0, 10**9)}"
    rows = []
    for i in range(40):
        base = [word() for _ in range(95)]
        rows += [(4 * i + k, " ".join(base + [word() for _ in range(5)] * 40)) for k in range(2)]
        base = [word() for _ in range(100)]
        rows += [(4 * i + 2, " ".join(base)), (4 * i + 3, " ".join(base + (base[:50] * 50)))]
    got = Counter((r["doc_id"], r["class_id"], r["n_class"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == classes(rows) and sum(n == 2 for _, _, n in got) == len(rows)


def test_one_of_each(docs, odd_docs, no_docs):
    for table in (docs, odd_docs):
        kept = minhash.one_of_each(table)
        assert kept.columns == table.columns
        n = minhash.near_duplicates(table).select("doc_id", "class_id", "n_class", "stays")
        rows = kept.collect()
        assert len(rows) == n.where("stays").distinct().count()
        assert minhash.near_duplicates(kept).where("n_class > 1").count() == 0
    assert minhash.one_of_each(no_docs).count() == 0


def test_signature_agreement_is_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 300, np.uint64)
    b = np.concatenate([a[:200], rng.integers(0, 1 << 63, 100, np.uint64)])
    doc = np.repeat([0, 1], 300)
    s = minhash.probminhash(doc, np.concatenate([a, b]), np.ones(600), 2, 512)
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.08


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60), st.sampled_from([1, 4, 1024]))
def test_suffix_array(values, least):
    s = np.array([*values, 0], np.int64)
    place = sais.places(s, least)
    order = sorted(range(len(s)), key=lambda i: s[i:].tolist())
    assert np.argsort(place).tolist() == order
    common = sais.permuted_common_prefixes(s, place)
    for a, b in zip(order, order[1:]):
        h = 0
        while a + h < len(s) and b + h < len(s) and s[a + h] == s[b + h]:
            h += 1
        assert common[b] == h


def removed(rows, width):
    """Brute force: (id, bytes, removed, spans, digest of the rest)."""
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + width] for r in raw for i in range(len(r) - width + 1))
    out = Counter()
    for (doc_id, _), r in zip(rows, raw):
        gone = bytearray(len(r))
        for i in range(len(r) - width + 1):
            if seen[r[i : i + width]] > 1:
                gone[i : i + width] = b"\x01" * width
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out[doc_id, len(r), sum(gone), len(bytes(gone).replace(b"\x00", b" ").split()), hashlib.sha256(kept).hexdigest()] += 1
    return out


def found(table, **parameters):
    got = substrings.deduplicate(table, **parameters).collect()
    return Counter((r["doc_id"], r["n_bytes"], sum(s["stop"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got)


@pytest.mark.parametrize("parameters", [{}, {"shard_bytes": 1}, {"shard_bytes": 3000, "gram": 16}])
def test_repeated_substrings(docs, parameters):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert found(docs, **parameters) == removed(rows, 200)


def test_odd_substrings(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    rows = [(i, t if t is None or len(t) < 10_000 else t[:3000]) for i, t in rows]
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), width=20, gram=8) == removed(rows, 20)
    assert found(odd_docs)[4, 180_000, 180_000, 1, hashlib.sha256(b"").hexdigest()] == 1
    assert substrings.deduplicate(no_docs).count() == 0


def test_a_run_of_one_byte(spark):
    rows = [(1, "a" * 700), (2, "b" + "a" * 150), (3, "é" * 90 + "xyz" * 80)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == removed(rows, 200)


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(substrings, "PIECE", 500)
    random.seed(1)
    text = "".join(random.choice("abcdefgh ") for _ in range(4000))
    data = np.frombuffer(text.encode(), np.uint8)
    starts = []
    for a in range(0, len(data), 500):
        piece = data[a : a + 500 + 199]
        first, n, _ = substrings.fragments(piece, np.array([0, len(piece)]), 200, 64)
        starts += [a + s + k for s, m in zip(first, n) for k in range(m)]
    assert sorted(starts) == list(range(len(text) - 199))


def test_row_key_is_the_text(spark):
    rows = spark.range(3).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("z" * 210), F.col("id").cast("string")).alias("text"))
    assert found(rows) == removed([(7, "z" * 210 + str(i)) for i in range(3)], 200)


def test_hot_anchors_are_split(spark):
    """One passage in many contexts, whose windows across its edges are unique, paired or shared by many."""
    random.seed(8)
    passage = "".join(random.choice("abcdefghijklmnop ") for _ in range(260))
    word = lambda n: "".join(random.choice("qrstuvwxyz") for _ in range(n))
    rows = [(i, word(random.choice([0, 3, 60, 150])) + passage[random.choice([0, 1, 30]) :] + word(random.choice([0, 5, 120]))) for i in range(60)]
    rows += [(100 + i, text) for i, (_, text) in enumerate(rows[:5])] + [(200, "same before " + passage + " same after"), (201, "not same before " + passage + " same after it")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (1, 400, 1 << 19):
        assert found(table, shard_bytes=most) == removed(rows, 200)


def test_digests_tell_fragments_apart():
    a = np.frombuffer(b"x" * 300, np.uint8)
    one, two = substrings._digests([a.data, a[:299].data]), substrings._digests([a.data, a.data])
    assert one[0][0] != one[0][1] and one[1][0] != one[1][1]
    assert two[0][0] == two[0][1] and two[1][0] == two[1][1]


def test_long_runs_are_linear():
    import time

    for values in (np.full(200_000, 7), np.tile([3, 3, 3, 9, 9], 40_000)):
        s = np.append(values, 0).astype(np.int64)
        start = time.time()
        place = sais.places(s)
        assert time.time() - start < 20
        assert sorted(place.tolist()) == list(range(len(s)))
    order = np.argsort(sais.places(np.append(np.full(5000, 7), 0)))
    assert order.tolist() == list(range(5000, -1, -1))


@pytest.mark.parametrize("rows", [0, 1000])
def test_components(spark, rows):
    random.seed(11)
    edges = [(random.randint(0, 150), random.randint(0, 150)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e if find(x) != x}
    got = components.components(spark.createDataFrame(edges, "u long, v long"), rows_in_one_task=rows)
    assert {r["node"]: r["root"] for r in got.collect()} == want
