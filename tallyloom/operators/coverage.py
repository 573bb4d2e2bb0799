"""How much of each place's reviews is collected, why some are missing, and what to scan next."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.functions import domain, filters as f, measures as m
from tallyloom.tables import Tables


def counted(t: Tables) -> DataFrame:
    """Places with sc (reviews held), sct (with text), ceil (what can be served), gap and coverage."""
    held = t.reviews.groupBy(F.col("place_id").alias("id")).agg(F.count(F.lit(1)).alias("sc"), m.n_if(f.has_text()).alias("sct"))
    rows = t.places.join(held, "id", "left").fillna(0, ["sc", "sct"])
    ceil = F.when(F.col("google_reviews_total").isNotNull(), F.least(F.col("google_reviews_total"), F.lit(domain.SERVE_CEILING)))
    return rows.withColumns({"ceil": ceil, "gap": ceil - F.col("sc"), "coverage": m.rate(F.col("sc"), F.nullif(ceil, F.lit(0)))})


def measurable(t: Tables) -> DataFrame:
    return counted(t).where(~F.col("scrape_excluded") & F.col("google_reviews_total").isNotNull())


def totals(t: Tables) -> DataFrame:
    """One row: places in and out of scope, reviews held and possible, work left, more than possible."""
    rows = counted(t)
    inside = ~F.col("scrape_excluded") & F.col("google_reviews_total").isNotNull()
    over = F.col("sc") > F.col("ceil")
    return rows.agg(
        F.count(F.lit(1)).alias("places"),
        m.n_if(F.col("scrape_excluded")).alias("excluded"),
        m.n_if(~F.col("scrape_excluded") & F.col("google_reviews_total").isNull()).alias("unmeasurable"),
        F.coalesce(F.sum(F.when(inside, F.col("sc"))), F.lit(0)).alias("held"),
        F.coalesce(F.sum(F.when(inside, F.col("ceil"))), F.lit(0)).cast("long").alias("possible"),
        m.n_if(inside & (F.col("gap") >= 50)).alias("gap_50"),
        m.n_if(inside & F.col("deep_scanned_at").isNull()).alias("never_deep"),
        m.n_if(inside & F.col("scraped_at").isNull()).alias("queued"),
        m.n_if(inside & (F.coalesce("refresh_shortfalls", F.lit(0)) >= 3)).alias("given_up"),
        m.n_if(inside & over).alias("over"),
        m.n_if(inside & over & (F.col("sct") > F.col("ceil"))).alias("over_with_text"),
    ).withColumn("coverage", m.rate(F.col("held"), F.nullif("possible", F.lit(0))))


def _band(value: Column, least: tuple, names: tuple, low: str) -> Column:
    out = F.lit(low)
    for x, name in zip(reversed(least), reversed(names)):
        out = F.when(value >= x, name).otherwise(out)
    return out


def coverage_bands(t: Tables) -> DataFrame:
    sc, ceil = F.col("sc"), F.col("ceil")
    band = F.when(sc >= ceil, "100+").when(sc >= 0.9 * ceil, "90-99").when(sc >= 0.5 * ceil, "50-89").when(sc >= 0.2 * ceil, "20-49").otherwise("under 20")
    return measurable(t).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("places"), F.sum(F.greatest(F.col("gap"), F.lit(0))).alias("missing"))


def size_bands(t: Tables) -> DataFrame:
    band = _band(F.col("google_reviews_total"), (1000, 500, 200, 50), ("1000+", "500-999", "200-499", "50-199"), "under 50")
    rows = measurable(t).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("places"), F.sum("sc").alias("held"), F.sum("ceil").cast("long").alias("possible"), m.n_if(F.col("sc") >= 0.9 * F.col("ceil")).alias("at_least_90"))
    return rows.withColumns({"coverage": m.rate(F.col("held"), F.nullif("possible", F.lit(0))), "missing": F.col("possible") - F.col("held")})


def by_zone(t: Tables) -> DataFrame:
    return measurable(t).groupBy(f.zone_of().alias("zone")).agg(F.count(F.lit(1)).alias("places"), F.sum("ceil").cast("long").alias("possible"), F.sum("sc").alias("held")).withColumn("coverage", m.rate(F.col("held"), F.nullif("possible", F.lit(0))))


def cause() -> Column:
    """Why a place is incomplete; the first rule that holds."""
    sc, ceil = F.col("sc"), F.col("ceil")
    return (
        F.when(sc == 0, "zero")
        .when(F.coalesce("refresh_shortfalls", F.lit(0)) >= 3, "gaveup")
        .when((ceil >= domain.SERVE_CEILING) & (sc >= 0.9 * ceil), "maxed")
        .when(F.col("deep_scanned_at").isNotNull(), "deep_done")
        .when(ceil > domain.REFRESH_CAP, "need_deep")
        .when(F.col("scraped_at").isNull(), "queued")
        .otherwise("cooldown")
    )


def incomplete(t: Tables) -> DataFrame:
    return measurable(t).where("sc < ceil").withColumn("cause", cause())


def causes(t: Tables) -> DataFrame:
    """Places and missing reviews by cause, with the place in the middle (index n // 2 of the sorted gaps).

    The middle is found by counting equal gaps, which are at most as many as a place may hold reviews.
    """
    rows = incomplete(t).groupBy("cause", "gap").agg(F.count(F.lit(1)).alias("c"))
    whole = rows.groupBy("cause").agg(F.sum("c").alias("places"), F.sum(F.col("gap") * F.col("c")).alias("missing"))
    upto = rows.withColumn("upto", F.sum("c").over(Window.partitionBy("cause").orderBy("gap"))).join(whole, "cause")
    middle = upto.where(F.col("upto") > F.floor(F.col("places") / 2)).groupBy("cause").agg(F.min("gap").alias("median_gap"))
    return whole.join(middle, "cause").select("cause", "places", "missing", "median_gap")


LISTED = ("id", "name", "google_reviews_total", "sc", "ceil", "gap")


def _listed(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(*LISTED, *more).orderBy(F.desc_nulls_last("gap"), "id")


def cooldown_days() -> Column:
    quiet = F.coalesce("consecutive_no_change", F.lit(0))
    return F.when(quiet >= 3, domain.COOLDOWN_LAST).when(quiet == 2, domain.COOLDOWN_DAYS[2]).otherwise(domain.COOLDOWN_DAYS[0])


def refresh_queue(t: Tables, as_of: date) -> DataFrame:
    """Places due for a scan: never scanned first, then the oldest; quiet places wait longer."""
    due = F.col("scraped_at").isNull() | (F.datediff(F.lit(as_of), "scraped_at") > cooldown_days())
    return t.places.where(~F.col("scrape_excluded") & due).orderBy(F.asc_nulls_first("scraped_at"), "id").select("id", "name", "scraped_at", cooldown_days().alias("cooldown_days"))


def round_yield(t: Tables, since: date) -> DataFrame:
    """What a round brought of what it could; no ratio if too little was expected."""
    rows = counted(t).where((F.col("scraped_at") >= F.lit(since)) & (F.col("google_reviews_total") >= 50))
    one = rows.agg(F.coalesce(F.sum("sc"), F.lit(0)).alias("got"), F.coalesce(F.sum("ceil"), F.lit(0)).cast("long").alias("expected"))
    ratio = F.when(F.col("expected") >= domain.YIELD_LEAST_EXPECTED, m.rate(F.col("got"), F.col("expected")))
    return one.withColumn("ratio", ratio).withColumn("stop", F.coalesce(F.col("ratio") < domain.YIELD_MIN, F.lit(False)))


def deep_targets(t: Tables, targets: str = "all", given_up=False, max_attempts=domain.DEEP_MAX_ATTEMPTS, limit: int | None = None) -> DataFrame:
    """Places for a deep scan: capped, zero, shallow, gap or all of the first three.

    shallow: many reviews whose dates span less than two years; gap: far below the ceiling,
    and that is above what a refresh collects (deep-scanned places too).
    """
    span = t.reviews.groupBy(F.col("place_id").alias("id")).agg(F.datediff(F.max("review_date_approx"), F.min("review_date_approx")).alias("span"))
    rows = counted(t).join(span, "id", "left").where(~F.col("scrape_excluded"))
    attempts = F.coalesce("deep_attempts", F.lit(0))
    rows = rows.where(attempts >= max_attempts if given_up else attempts < max_attempts)
    capped = F.col("sc") >= domain.DEEP_CAPPED
    zero = F.col("sc") == 0
    shallow = (F.col("sc") >= domain.DEEP_SHALLOW) & (F.col("span") < 730)
    gap = (F.col("ceil") > domain.REFRESH_CAP) & (F.col("gap") >= domain.DEEP_GAP)
    wanted = {"capped": capped, "zero": zero, "shallow": shallow, "gap": gap}.get(targets, capped | zero | shallow)
    if targets != "gap":
        rows = rows.where("deep_scanned_at IS NULL")
    rows = rows.where(F.coalesce(wanted, F.lit(False))).orderBy(F.desc_nulls_last("gap" if targets == "gap" else "sc"), "name").select(*LISTED)
    return rows if limit is None else rows.limit(limit)


def requeue(t: Tables, least_coverage=0.5, least_total=50, most_shortfalls=3) -> DataFrame:
    """Scanned places that came out far below what they could."""
    rows = measurable(t).where(F.col("scraped_at").isNotNull() & (F.col("google_reviews_total") >= least_total) & (F.coalesce("refresh_shortfalls", F.lit(0)) < most_shortfalls))
    return _listed(rows.where(F.col("sc") < least_coverage * F.col("ceil")), "consecutive_no_change", "refresh_shortfalls")


def stuck(t: Tables, least_quiet=3) -> DataFrame:
    """Never scanned, yet counted as quiet."""
    return _listed(counted(t).where(~F.col("scrape_excluded") & F.col("scraped_at").isNull() & (F.coalesce("consecutive_no_change", F.lit(0)) >= least_quiet)), "consecutive_no_change")


def false_deep(t: Tables) -> DataFrame:
    """Marked as deep-scanned with less than half of what they could hold."""
    return _listed(measurable(t).where(F.col("deep_scanned_at").isNotNull() & (F.col("sc") < domain.DEEP_MIN_RATIO * F.col("ceil"))), "deep_attempts")


def spent_attempts(t: Tables, max_attempts=domain.DEEP_MAX_ATTEMPTS, ratio=0.8) -> DataFrame:
    """Given up after too many attempts, below a share of what they could hold."""
    return _listed(measurable(t).where((F.coalesce("deep_attempts", F.lit(0)) >= max_attempts) & (F.col("sc") < ratio * F.col("ceil"))), "deep_attempts")


def enough(collected: Column, ceiling: Column) -> Column:
    """Whether a deep scan counts as done."""
    return (collected > 0) & ((ceiling == 0) | (collected >= domain.DEEP_MIN_RATIO * ceiling))


def coverage_list(t: Tables) -> DataFrame:
    """Every measurable place with its percentage, the largest gap first."""
    return _listed(measurable(t).withColumn("percent", F.round(F.col("coverage") * 100, 1)), "percent")
