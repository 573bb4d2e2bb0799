"""Hard negatives against scoring of all pairs, and the bounds that rule rows out."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from tallyloom.llm import negatives, queries

ROWS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())] + [T.StructField(n, T.StringType()) for n in ("id", "codes", "rest", "vector", "owner", "a.b", "we`ird")])


def taking_part(rows):
    out = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            out.append((i, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    return out


def mined(rows, every, positives=5, k=5, percent=80):
    rows = taking_part(rows)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, label, v in rows:
        if i % every:
            continue
        own = sorted((-dot(v, w), j) for j, other, w in rows if other == label and j != i)[:positives]
        rest = sorted((-dot(v, w), j) for j, other, w in rows if other != label and j != i)
        for s, p in own:
            fits = [(j, -t) for t, j in rest if percent * -s <= 100 * -t <= 100 * -s][:k]
            out += [(i, p, r, j, -s, t) for r, (j, t) in enumerate(fits, 1)]
    return sorted(out)


def told(df):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["c"] * 7) for r in rows], ROWS)


def run(df, every, **how):
    rows, quantiser = negatives.index(negatives.integers(df), **{k: how.pop(k) for k in ("sample_rows", "width", "groups") if k in how})
    return negatives.mine(rows, quantiser, rows.where(F.col("id") % every == 0), **how)


@pytest.fixture(scope="module")
def made():
    """Clusters that labels cut across, a hot label, equal vectors and ties."""
    pick = np.random.default_rng(7)
    centres = pick.normal(size=(6, 10))
    rows = [(i, (centres[i % 6] + 0.3 * pick.normal(size=10)).astype(np.float32).tolist(), int(pick.integers(0, 3)) if i % 3 else 0) for i in range(400)]
    return rows + [(1000 + i, rows[5][1], i % 4) for i in range(40)]


@pytest.mark.parametrize(("width", "groups", "sample_rows"), [(2, 4, 4096), (3, 1, 50), (10, 2, 300), (1, 100, 2)])
def test_bounds_hold(made, width, groups, sample_rows):
    vectors = np.array([v for _, _, v in taking_part(made)], float)
    quantiser = negatives.Quantiser.fit(vectors[:sample_rows], width, groups)
    codes, rest = quantiser.encode(vectors)
    score, off = quantiser.bounds(codes, rest, quantiser.tables(vectors[:50]))
    assert (np.abs(score - vectors @ vectors[:50].T) <= off + 1e-6).all()


@pytest.mark.parametrize("how", [{}, {"block": 7, "at_once": 3}, {"width": 5, "groups": 1, "sample_rows": 20}, {"positives": 2, "negatives": 9, "percent": 50}])
def test_all_pairs(spark, made, how):
    want = mined(made, 10, how.get("positives", 5), how.get("negatives", 5), how.get("percent", 80))
    assert len(want) > 100
    assert told(run(frame(spark, made).repartition(3), 10, **how)) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.85, 0.1], 2), (3, None, 1), (4, [1.0, None], 1), (5, [nan, 1.0], 2), (6, [inf, 1.0], 2), (7, [1.0, 1.0], None), (None, [1.0, 0.0], 2)]
    rows += [(8, [0.88], 2), (9, [], 2), (2, [0.85, 0.1], 2), (1, [0.9, 0.1], 1), (0, [1.0, 0.0], 1), (10, [-1.0, 0.0], 3), (11, [1.0, 0.5], 3), (20, [0.0, 0.0], 4), (21, [0.0, 0.0], 4)]
    assert told(run(frame(spark, rows), 10)) == mined(rows, 10)


def test_few_rows(spark):
    assert told(run(frame(spark, []), 10)) == []
    assert told(run(frame(spark, [(0, [1.0], 1)]), 10)) == []
    assert told(run(frame(spark, [(0, [1.0], 1), (1, [1.0], 1)]), 10)) == []


def test_too_large_component(spark):
    with pytest.raises(Exception, match="beyond"):
        run(frame(spark, [(0, [1e6], 1), (1, [1.0], 1)]), 10)


def test_query(spark, small):
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["label"] is not None and r["vec_id"] % 7 == 0 else r["label"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert told(queries.op12_negatives(spark, small)) == mined(rows, 100)
