"""One-to-one choices against a plain loop, and the rounds that long chains take."""

import random

import pytest

from tallyloom.functions import geo
from tallyloom.operators import dedup

SCHEMA = "drop long, keep long, dist double, off long"


def in_order(pairs):
    taken, out = set(), []
    for drop in sorted({p[0] for p in pairs}):
        free = sorted((p[2], p[3], p[1]) for p in pairs if p[0] == drop and p[1] not in taken)
        if free:
            taken.add(free[0][2])
            out.append((drop, free[0][2], free[0][0]))
    return sorted(out)


@pytest.mark.parametrize("most_pairs", [1_000_000, 8])
def test_same_as_a_loop(spark, most_pairs):
    pick = random.Random(most_pairs)
    pairs = sorted({(pick.randint(0, 60), 1000 + pick.randint(0, 50)) for _ in range(45)})
    pairs = [(d, k, float(pick.randint(1, 4)), pick.randint(0, 2)) for d, k in pairs]
    got = dedup.greedy(spark.createDataFrame(pairs, SCHEMA).repartition(3), most_pairs).collect()
    assert sorted(map(tuple, got)) == in_order(pairs)


def test_no_pairs(spark):
    assert dedup.greedy(spark.createDataFrame([], SCHEMA)).count() == 0


def chains(lengths):
    """Each place wants the keep that the one before could have, so turns come one by one."""
    out, at = [], 0
    for n in lengths:
        out += [p for i in range(at, at + n) for p in ((i, 100_000 + i, 1.0, 0), (i, 100_000 + i + 1, 2.0, 0))]
        at += n + 1
    random.Random(1).shuffle(out)
    return out


@pytest.mark.parametrize(("lengths", "most_pairs", "most_writes"), [([10_000], 1_000_000, 2), ([200, 60, 60, 10], 450, 3 * 20)])
def test_long_chains_take_few_rounds(spark, monkeypatch, lengths, most_pairs, most_writes):
    pairs, writes, one = chains(lengths), [], dedup.cut
    monkeypatch.setattr(dedup, "cut", lambda df: writes.append(1) or one(df))
    got = dedup.greedy(spark.createDataFrame(pairs, SCHEMA), most_pairs).collect()
    assert sorted((r["drop"], r["keep"]) for r in got) == [(i, 100_000 + i) for i in sorted({p[0] for p in pairs})]
    assert len(writes) <= most_writes  # three or four a round


def test_components(spark):
    edges = [(1, 2), (3, 2), (5, 6), (6, 7), (7, 5), (9, 8), (4, 4)]
    assert {r["node"]: r["root"] for r in dedup.components(spark.createDataFrame(edges, "u long, v long")).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 5, 8: 8, 9: 8}


@pytest.mark.parametrize(("n_drops", "n_keeps", "metres"), [(120, 400, 4000.0), (200, 90, 2500.0)])
def test_short_lists_choose_as_all_pairs(spark, monkeypatch, n_drops, n_keeps, metres):
    pick = random.Random(n_keeps)
    at = lambda: (16.5 + pick.randint(0, 60) / 1000, 100.2 + pick.randint(0, 60) / 1000)
    drops = spark.createDataFrame([(i, pick.choice([None, 5, 9]), *at()) for i in range(n_drops)], "id long, google_reviews_total int, lat double, lng double")
    keeps = spark.createDataFrame([(1000 + i, pick.randint(1, 9), *at()) for i in range(n_keeps)], "id long, sc long, lat double, lng double")
    every = geo.grid_pairs(drops, keeps, metres).selectExpr("l_id", "r_id", "dist", "abs(coalesce(l_google_reviews_total, 0) - r_sc)").collect()
    sizes, one = [], dedup.greedy
    monkeypatch.setattr(dedup, "greedy", lambda pairs: sizes.append(pairs.count()) or one(pairs))
    got = dedup.nearest_free(drops, keeps, metres, most=2).collect()
    assert sorted(map(tuple, got)) == in_order(list(map(tuple, every)))
    assert sizes[0] <= 3 * n_drops < len(every)
