"""Duplicate reviews and places, and moves and deletes that keep children consistent."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tallyloom.functions import domain, filters as f, geo, text as x
from tallyloom.operators import coverage
from tallyloom.sources.scratch import cut
from tallyloom.tables import Tables


def ranked(t: Tables) -> DataFrame:
    """Reviews with eff (the text compared) and rn: 1 is the copy that stays, one with labels before others."""
    rows = t.labelled("left").withColumn("eff", x.effective_text(F.col("text_clean"), F.col("text")))
    order = Window.partitionBy("place_id", "eff").orderBy(F.desc(F.col("analysis_id").isNotNull()), "id")
    return rows.withColumn("rn", F.row_number().over(order))


def survey(t: Tables) -> DataFrame:
    rows = ranked(t)
    per_group = rows.groupBy("place_id", "eff").agg(F.count(F.lit(1)).alias("c"), F.sum(F.when((F.col("rn") > 1) & F.col("analysis_id").isNotNull(), 1).otherwise(0)).alias("lost"), F.count("analysis_id").alias("labelled"))
    return per_group.agg(
        F.sum("c").alias("total_reviews"),
        F.sum("labelled").alias("total_analyzed"),
        F.count(F.when(F.col("c") > 1, 1)).alias("dup_groups"),
        F.sum(F.col("c") - 1).alias("extra_rows"),
        F.sum("lost").alias("analyzed_lost"),
    )


def kept(t: Tables) -> DataFrame:
    return ranked(t).where("rn = 1").select("id", "place_id", "eff")


def deleted(t: Tables) -> Tables:
    """All tables without the extra copies; their labels go with them."""
    extra = ranked(t).where("rn > 1").select("id")
    return Tables(t.places, t.reviews.join(extra, "id", "left_anti"), t.analyzed.join(extra.withColumnRenamed("id", "review_id"), "review_id", "left_anti"), t.candidates, t.cells)


def wrong_hashes(reviews: DataFrame) -> DataFrame:
    """Reviews whose stored hash isn't that of their text, null included."""
    return reviews.withColumn("expected", x.review_text_hash(F.col("text"))).where(~F.col("text_hash").eqNullSafe(F.col("expected")))


def cross_place(t: Tables, longer_than=40) -> tuple[DataFrame, DataFrame]:
    """Reviews to drop from the place that holds more than it could, and groups without such a place."""
    rows = t.reviews.where(F.length(F.coalesce("text_clean", F.lit(""))) > longer_than).select("id", "place_id", F.col("text_clean").alias("body"))
    several = rows.groupBy("body").agg(F.min("place_id").alias("a"), F.max("place_id").alias("b"), F.count(F.lit(1)).alias("n")).where("a < b").select("body", "n")
    over = coverage.counted(t).select(F.col("id").alias("place_id"), F.when(F.col("ceil") > 0, F.col("sc") - F.col("ceil")).alias("over"))
    cases = rows.join(several, "body").join(over, "place_id", "left")
    first = F.row_number().over(Window.partitionBy("body").orderBy(F.desc("over"), "id"))
    drops = cases.where("over > 0").withColumn("n_th", first).where("n_th = 1").select(F.col("id").alias("rid"), F.col("place_id").alias("pid"), "over")
    undecided = cases.groupBy("body").agg(F.count(F.lit(1)).alias("n"), F.max("over").alias("most"), F.concat_ws(",", F.sort_array(F.collect_set("place_id"))).alias("pids")).where(~(F.coalesce("most", F.lit(0)) > 0)).select("body", "n", "pids")
    return drops, undecided


def place_pairs(t: Tables, metres=40.0) -> DataFrame:
    """(keep, drop, dist): an unscanned place of the API within reach of a scanned one without external id.

    Greedy and one to one: unscanned places in order of id each take the nearest free
    one (then the one with the closest number of reviews).
    """
    rows = coverage.counted(t).select("id", "google_place_id", "google_reviews_total", "sc", "lat", "lng")
    api = rows.where(F.col("google_place_id").isNotNull() & (F.col("sc") == 0))
    scanned = rows.where(F.col("google_place_id").isNull() & (F.col("sc") > 0))
    return nearest_free(cut(api), cut(scanned), metres)


def nearest_free(drops: DataFrame, keeps: DataFrame, metres: float, most: int = 16) -> DataFrame:
    """:func:`greedy` over all pairs of ``drops`` and ``keeps`` within ``metres``, of which only those that matter are made.

    Each drop has a list of its best keeps: at most ``most``, within a reach that the density gives.
    A drop that finds none free on a list that isn't whole gets a longer one, and choices are made
    anew.  Once every drop without a keep has a whole list, all others took the first free keep of
    the beginning of theirs, so the choices are those of the whole lists.
    """
    reach, listed, whole, todo = _reach(drops, keeps, metres, most), None, None, drops
    while True:
        near = geo.grid_pairs(todo, keeps, reach).select(F.col("l_id").alias("drop"), F.col("r_id").alias("keep"), "dist", F.abs(F.coalesce("l_google_reviews_total", F.lit(0)) - F.col("r_sc")).alias("off"))
        best = near.withColumn("n", F.row_number().over(Window.partitionBy("drop").orderBy("dist", "off", "keep"))).where(F.col("n") <= most + 1)
        ids = todo.select(F.col("id").alias("drop"))
        listed = cut(best if listed is None else listed.join(ids, "drop", "left_anti").unionByName(best))
        if reach >= metres:
            ended = ids.join(listed.where(F.col("n") > most).select("drop"), "drop", "left_anti")
            whole = cut(ended if whole is None else whole.unionByName(ended))
        settled = cut(greedy(listed))
        open_ = drops.join(settled.select(F.col("drop").alias("id")), "id", "left_anti")
        todo = cut(open_ if whole is None else open_.join(whole.select(F.col("drop").alias("id")), "id", "left_anti"))
        if todo.isEmpty():
            return settled
        reach, most = min(4 * reach, metres), 4 * most


def _reach(drops: DataFrame, keeps: DataFrame, metres: float, most: int) -> float:
    """Metres within which a drop has about ``most`` keeps, by how many share its square."""
    squares = lambda df, n: df.where("lat IS NOT NULL AND lng IS NOT NULL").groupBy(F.floor(F.col("lat") * 110_000 / metres).alias("gy"), F.floor(F.col("lng") * 90_000 / metres).alias("gx")).agg(F.count(F.lit(1)).alias(n))
    mean = squares(drops, "a").join(squares(keeps, "b"), ["gy", "gx"], "left").agg(F.sum(F.col("a") * F.col("b")) / F.sum("a")).first()[0] or 0
    return metres if mean * math.pi <= most else metres * math.sqrt(most / (mean * math.pi))


def greedy(pairs: DataFrame, most_pairs: int = 1_000_000) -> DataFrame:
    """One-to-one choice from (drop, keep, dist, off), in order of drop; each takes its nearest free keep.

    At most ``most_pairs`` pairs are one sorted stream, of which a task holds the keeps that are
    taken.  Of more, each connected part of the pairs is one, as choices depend on each other
    only within it; parts are found in rounds that grow with the logarithm of a part's
    diameter.  Parts of still more pairs are settled in rounds of joins instead, so that no
    task gets them.
    """
    pairs = cut(pairs.select("drop", "keep", "dist", "off"))
    if pairs.count() <= most_pairs:
        return pairs.withColumn("root", F.lit(0)).coalesce(1).sortWithinPartitions("drop", "dist", "off", "keep").select("root", "drop", "keep", "dist").mapInPandas(_in_turn, "drop long, keep long, dist double")
    roots = components(pairs.select(F.col("drop").alias("u"), F.col("keep").alias("v")))
    placed = pairs.join(roots.select(F.col("node").alias("drop"), "root"), "drop")
    large = cut(placed.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_pairs).select("root"))
    streams = placed.join(large, "root", "left_anti").repartition("root").sortWithinPartitions("root", "drop", "dist", "off", "keep")
    settled = streams.select("root", "drop", "keep", "dist").mapInPandas(_in_turn, "drop long, keep long, dist double")
    if large.isEmpty():
        return settled
    return settled.unionByName(_in_rounds(placed.join(large, "root", "left_semi").select("drop", "keep", "dist", "off")))


def _in_turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs in order of part, drop and choice: the first free keep of each drop."""
    part, served, taken = None, None, set()
    for batch in batches:
        rows = []
        for root, drop, keep, dist in batch.itertuples(index=False):
            if root != part:
                part, served, taken = root, None, set()
            if drop != served and keep not in taken:
                served = drop
                taken.add(keep)
                rows.append((drop, keep, dist))
        yield pd.DataFrame(rows, columns=["drop", "keep", "dist"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of undirected edges (u, v): the least node of each connected part.

    Every root hooks on to the least root that an edge leads to, then all nodes follow their roots
    twice over; so a chain is a quarter as long after each round.
    """
    ends = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    roots, edges = cut(ends.select("node", F.col("node").alias("root"))), cut(edges.select("u", "v").distinct())
    while True:
        of = lambda column: roots.select(F.col("node").alias(column), F.col("root").alias(f"r{column}"))  # noqa: E731, B023
        edges = edges.join(of("u"), "u").join(of("v"), "v").where("ru != rv").select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct()
        edges = cut(edges)
        if edges.isEmpty():
            return roots
        hooks = edges.groupBy(F.greatest("u", "v").alias("root")).agg(F.min(F.least("u", "v")).alias("to"))
        hooked = roots.join(hooks, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        for _ in range(2):
            above = hooked.select(F.col("node").alias("root"), F.col("root").alias("above"))
            hooked = cut(hooked.join(above, "root").select("node", F.col("above").alias("root")))
        roots = hooked


def _in_rounds(pairs: DataFrame) -> DataFrame:
    """Rounds of joins settle all places whose turn has come: one whose best choice no earlier place still wants."""
    settled = None
    while not pairs.isEmpty():
        choice = pairs.withColumn("n", F.row_number().over(Window.partitionBy("drop").orderBy("dist", "off", "keep"))).where("n = 1")
        # A place is served once no earlier one still has its choice on the list.
        earliest = pairs.groupBy("keep").agg(F.min("drop").alias("first"))
        served = cut(choice.join(earliest, "keep").where("drop = first").select("drop", "keep", "dist"))
        settled = served if settled is None else settled.unionByName(served)
        pairs = cut(pairs.join(served.select("drop"), "drop", "left_anti").join(served.select("keep"), "keep", "left_anti"))
    return settled


def common_hashes(t: Tables, a: int, b: int) -> DataFrame:
    """Texts that two places share: a self-join on the hash."""
    rows = t.reviews.select("place_id", x.review_text_hash(F.col("text")).alias("h"))
    one, two = rows.where(F.col("place_id") == a).select("h").distinct(), rows.where(F.col("place_id") == b).select("h").distinct()
    return one.join(two, "h")


def distance_between(t: Tables, a: int, b: int) -> DataFrame:
    """One row: the metres between two places."""
    one = lambda place, lat, lng: t.places.where(F.col("id") == place).select(F.col("lat").alias(lat), F.col("lng").alias(lng))
    both = one(a, "lat_a", "lng_a").crossJoin(one(b, "lat_b", "lng_b"))
    return both.select(geo.haversine(F.col("lat_a"), F.col("lng_a"), F.col("lat_b"), F.col("lng_b"), geo.M).alias("metres"))


def near_twins(t: Tables, metres=40.0) -> DataFrame:
    """Pairs of places within reach of each other, both ids in order."""
    rows = coverage.counted(t).select("id", "name", "lat", "lng", "sc")
    return geo.grid_pairs(rows, rows, metres).where("l_id < r_id").select(F.col("l_id").alias("a"), F.col("r_id").alias("b"), "dist", F.col("l_sc").alias("a_reviews"), F.col("r_sc").alias("b_reviews"))


def merged(t: Tables, moves: DataFrame) -> Tables:
    """Tables after places ``drop`` have gone into ``keep``: reviews move unless the text is there already.

    Missing API columns of the kept place are filled from the dropped one.
    """
    to = moves.select(F.col("drop").alias("place_id"), F.col("keep").alias("_to"))
    hashed = t.reviews.join(to, "place_id", "left").withColumn("_h", x.review_text_hash(F.col("text")))
    target = hashed.withColumn("_place", F.coalesce("_to", "place_id"))
    first = F.row_number().over(Window.partitionBy("_place", "_h").orderBy(F.col("_to").isNotNull(), "id"))
    ranked_ = target.withColumn("_n", first).withColumn("_gone", F.col("_to").isNotNull() & (F.col("_n") > 1))
    reviews = ranked_.where("NOT _gone").withColumn("place_id", F.col("_place")).select(*t.reviews.columns)
    gone = ranked_.where("_gone").select(F.col("id").alias("review_id"))
    api = ("google_place_id", "google_types", "google_reviews_total")
    dropped = t.places.join(to.withColumnRenamed("place_id", "id"), "id").select(F.col("_to").alias("id"), *(F.col(c).alias(f"_{c}") for c in api))
    filled = t.places.join(to.select(F.col("place_id").alias("id")), "id", "left_anti").join(dropped, "id", "left")
    places = filled.withColumns({c: F.coalesce(f"_{c}", c) for c in api}).select(*t.places.columns)
    return Tables(places, reviews, t.analyzed.join(gone, "review_id", "left_anti"), t.candidates, t.cells)


def without_places(t: Tables, ids: DataFrame, force=False) -> Tables:
    """Tables without places and all that hangs on them; places with reviews stay unless forced."""
    doomed = ids.select("id")
    if not force:
        doomed = doomed.join(t.reviews.select(F.col("place_id").alias("id")), "id", "left_anti")
    reviews = t.reviews.join(doomed.withColumnRenamed("id", "place_id"), "place_id", "left_anti")
    return Tables(t.places.join(doomed, "id", "left_anti"), reviews, t.analyzed.join(reviews.select(F.col("id").alias("review_id")), "review_id", "left_semi"), t.candidates, t.cells)


def dirty_labels(t: Tables) -> DataFrame:
    """Specific categories on reviews that have no text."""
    rows = t.labelled().where(~f.has_text() & F.col("pain_point_category").isNotNull() & (F.col("pain_point_category") != domain.GENERAL))
    return rows.groupBy(F.col("pain_point_category").alias("cat")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cat")


def unsupported_keywords(t: Tables, words: tuple[str, ...]) -> DataFrame:
    """Labels with one of these keywords though the text doesn't hold it."""
    claims = F.exists("keywords", lambda k: k.isin(*words) & ~F.coalesce(F.col("text_clean"), F.lit("")).contains(k))
    return t.labelled().where(claims).select("id", "keywords")
