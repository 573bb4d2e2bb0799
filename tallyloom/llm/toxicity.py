"""Toxic passages as maximum-scoring segments (operator 9).

Fitting: every word, and every beginning of ``BEGINS`` characters of a longer one, gets its
log-odds of standing in toxic rather than clean labelled texts, under an informative
Dirichlet prior (the frequencies of both classes together), less ``z`` standard errors;
so odds shrink with the evidence and no word is left out by a count.  A beginning stands for
words that were never seen, so it needs ``least_words`` distinct words that stand rather in
toxic texts, and has no more than the log-odds of such words among all that share it (one
insult, however frequent, says nothing of other words that begin like it).  A word scores
the best supported of its whole and its beginnings (0 at least) less ``drift``, but one that
is known from clean texts (odds surely below 0) isn't judged by its beginning.  As odds are
of standing in a text at all, the k-th occurrence in a text has a k-th of them.
The fit reads at most about ``sample_rows`` labelled rows, and near copies among them
(equal least hash of shingles, by any of three hash functions) count once, as words that
only copies share are no evidence.

Scoring: one linear scan over the words of a whole text finds all maximal scoring
segments.  A segment of score s is set against the extreme-value law of clean texts
(Karlin-Altschul: K n exp(-lambda s) such segments are expected in n words); all segments
with an expected number below 1 add up their distance to it, and a logistic curve over
that sum gives the document's score.  Both the law (from the peaks of clean texts' segment
scores) and the curve are fitted on scores that a model of the other folds gives, so no
text is calibrated by odds it helped to set.  Segments whose expected number is below
``significance`` are the toxic passages.

Defined results: a null, empty or wordless text has no segment and the score of a text
of neutral words; very long texts are scanned whole; repeated rows give repeated
rows; labels that are null or not 0/1 are left out, and a doc_id labelled twice counts
as toxic if one label says so; other columns are not read, and ``without_toxic`` keeps
them whatever their names; with no labelled rows of one class every text scores the
share of toxic ones (0 without labels); an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.llm import common, tokens

BEGINS = (3, 4, 5, 6, 7)
FOLDS = 5
#: Words whose scores a task remembers.
KNOWN = 30_000
SCORED = "doc_id long, n_words long, best double, expected double, score double, passages array<struct<first:int,last:int,score:double>>"


@dataclass
class Model:
    #: Raised odds of whole words (key "word ") and of beginnings (key "begi").
    odds: dict[str, float] = field(default_factory=dict)
    #: Words that begin as toxic ones do, but are known from clean texts.
    known_clean: frozenset[str] = frozenset()
    drift: float = 0.2
    lam: float = 1.0
    log_k: float = 0.0
    intercept: float = -20.0
    slope: float = 0.0

    def word(self, w: str) -> float:
        """Score of a word's first occurrence."""
        if w in self.known_clean:
            return -self.drift
        return max(self.odds.get(w + " ", 0.0), max((self.odds.get(w[:k], 0.0) for k in BEGINS if k < len(w)), default=0.0)) - self.drift

    def log_expected(self, best: float, n: int) -> float:
        """Log of how many segments of that score or more are expected in a clean text of n words."""
        return self.log_k + math.log(max(1, n)) - self.lam * best

    def evidence(self, scores: list[float], n: int) -> float:
        """Sum over all segments of how far their expected number is below 1, in logs."""
        return sum(max(0.0, -self.log_expected(s, n)) for s in scores)

    def score(self, scores: list[float], n: int) -> float:
        z = self.intercept + self.slope * self.evidence(scores, n)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-case words of all texts in a row, and where each text's words begin."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    spaced = pc.utf8_trim(pc.replace_substring_regex(low, r"[^\p{L}\p{N}]+", " "), " ")
    lists = pc.split_pattern(spaced, " ")
    at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    values = lists.values
    empty = pc.equal(values, "").to_numpy(zero_copy_only=False)
    if empty.any():  # a text without words still gives one empty string
        at = at - np.concatenate([[0], np.cumsum(empty)])[at]
        values = values.filter(pa.array(~empty))
    return values, at


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (Ruzzo and Tompa), as (first, last, score).

    Only positive words can open or end one, so the scan steps from one to the next.
    """
    at = np.flatnonzero(scores > 0)
    total = np.cumsum(scores)
    left: list[float] = []
    right: list[float] = []
    ends: list[tuple[int, int]] = []
    #: For each segment, the nearest earlier one with a lower left sum.
    lower: list[int] = []
    for i in at.tolist():
        lo, hi, first = float(total[i] - scores[i]), float(total[i]), i
        while True:
            j = len(ends) - 1
            while j >= 0 and left[j] >= lo:
                j = lower[j]
            if j < 0 or right[j] >= hi:
                lower.append(j)
                left.append(lo)
                right.append(hi)
                ends.append((first, i))
                break
            lo, first = left[j], ends[j][0]
            del left[j:], right[j:], ends[j:], lower[j:]
    return [(a, b, r - x) for (a, b), x, r in zip(ends, left, right)]


def _features(w: str) -> list[str]:
    return [w + " ", *(w[:k] for k in BEGINS if k < len(w))]


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each token by fold and class, added up in each slice; columns text, toxic, fold."""
    tokens.retire()
    for whole in batches:
        for batch in tokens.slices(whole, 0, 1_000_000):
            values, at = words_of(batch.column(0))
            coded = values.dictionary_encode()
            names: dict[str, int] = {}
            own = [np.array([names.setdefault(f, len(names)) for f in _features(w)], np.int64) for w in coded.dictionary.to_pylist()]
            size = np.fromiter(map(len, own), np.int64, len(own))
            begin, flat = np.cumsum(size) - size, np.concatenate(own) if own else np.empty(0, np.int64)
            n = max(1, len(names))
            ids = coded.indices.to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
            pair = np.unique(doc * max(1, len(own)) + ids)
            d, w = pair // max(1, len(own)), pair % max(1, len(own))
            places = tokens._places(begin[w], size[w])
            pair = np.unique(np.repeat(d, size[w]) * n + flat[places])
            d, k = pair // n, pair % n
            cell = batch.column(2).to_numpy()[d] * 2 + batch.column(1).to_numpy()[d]
            counts = np.bincount(k * (2 * FOLDS) + cell, minlength=n * 2 * FOLDS).reshape(n, 2 * FOLDS)[: len(names)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array(c) for c in np.ascontiguousarray(counts.T.astype(np.int64)))], ["token", *(f"c{c}" for c in range(2 * FOLDS))])


def _odds(toxic: Column, clean: Column, n1, n0, prior_mass: float, z: float, cap: float) -> Column:
    """Log-odds with an informative Dirichlet prior, less ``z`` standard errors (plus, where it is negative)."""
    n1, n0 = (n if isinstance(n, Column) else F.lit(float(n)) for n in (n1, n0))
    share = (toxic + clean) / (n1 + n0)
    prior = F.greatest(F.lit(0.5), F.lit(prior_mass) * share)
    a1, a0 = toxic + prior, clean + prior
    odds = F.ln(a1 / (n1 + prior_mass)) - F.ln(a0 / (n0 + prior_mass))
    return F.least(F.lit(cap), odds - z * F.sqrt(1 / a1 + 1 / a0))


def _segment_scores(models: list[Model]):
    """toxic, n_words and all segment scores of (text, toxic, fold) rows, each under its fold's model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[dict[str, float]] = [{} for _ in models]
        for whole in batches:
            for batch in tokens.slices(whole, 0, 1_000_000):
                fold, found, n_words = batch.column(2).to_numpy(), [], []
                values, at = words_of(batch.column(0))
                for k in range(batch.num_rows):
                    own = values.slice(int(at[k]), int(at[k + 1] - at[k]))
                    scores = _word_scores(own, np.array([0, len(own)]), models[fold[k]], known[fold[k]])
                    found.append([s for _, _, s in segments(scores)])
                    n_words.append(len(own))
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n_words, pa.int64()), pa.array(found, pa.list_(pa.float64()))], ["toxic", "n_words", "scores"])

    return run


def _word_scores(values: pa.Array, at: np.ndarray, model: Model, known: dict[str, float]) -> np.ndarray:
    """Scores of all words of texts that begin at ``at``; the k-th occurrence in a text has a k-th of the raised odds."""
    coded = values.dictionary_encode()
    own = []
    for w in coded.dictionary.to_pylist():
        s = known.get(w)
        if s is None:
            s = model.word(w)
            if len(known) < KNOWN:  # a memory of words met before; others are looked up anew
                known[w] = s
        own.append(s)
    if not len(values):
        return np.empty(0)
    index = coded.indices.to_numpy().astype(np.int64)
    scores = np.array(own, np.float64)[index]
    hot = np.flatnonzero(scores > 0)
    pair = np.repeat(np.arange(len(at) - 1), np.diff(at))[hot] * len(own) + index[hot]
    order = np.argsort(pair, kind="stable")
    first = np.append(True, np.diff(pair[order]) != 0)
    place = np.arange(len(hot))
    nth = np.empty(len(hot), np.int64)
    nth[order] = place - np.maximum.accumulate(np.where(first, place, 0)) + 1 if len(hot) else 0
    scores[hot] = (scores[hot] + model.drift) / nth - model.drift
    return scores


def _scan(model: Model, significance: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.retire()
        known: dict[str, float] = {}
        for whole in batches:
            for batch in tokens.slices(whole, 1):
                values, at = words_of(batch.column(1))
                scores = _word_scores(values, at, model, known)
                hot = np.diff(np.append(0, np.cumsum(scores > 0))[at]) > 0
                best, expected, score, passages = [], [], [], []
                for k, n in enumerate(np.diff(at).tolist()):
                    found = segments(scores[at[k] : at[k + 1]]) if hot[k] else []
                    own = [s for _, _, s in found]
                    best.append(max(own, default=0.0))
                    expected.append(math.exp(min(700.0, model.log_expected(best[-1], n))))
                    score.append(model.score(own, n))
                    passages.append([{"first": a, "last": b, "score": s} for a, b, s in found if model.log_expected(s, n) < math.log(max(significance, 1e-300))])
                kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).cast(pa.int64()), pa.array(np.diff(at).astype(np.int64)), pa.array(best, pa.float64()), pa.array(expected, pa.float64()), pa.array(score, pa.float64()), pa.array(passages, kind)],
                    ["doc_id", "n_words", "best", "expected", "score", "passages"],
                )

    return run


def labelled(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """(text, toxic, h) of the bounded sample; equal texts count once a label."""
    own = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    total = own.count()
    share = min(1.0, sample_rows / max(1, total))
    own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 24)) < F.lit(math.ceil(share * (1 << 24))))
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(own, "doc_id").select("text", "toxic", F.xxhash64("text").alias("h"))
    return rows.dropDuplicates(["h", "toxic"])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the least hashes of their shingles under three hash functions."""
    from tallyloom.llm import minhash

    tokens.retire()
    for whole in batches:
        for batch in tokens.slices(whole, 0):
            words, at = minhash.word_hashes(batch.column(0))
            keys = np.zeros((3, batch.num_rows), np.uint64)
            for i in range(batch.num_rows):
                own = minhash.shingles(words[at[i] : at[i + 1]], 3)
                if len(own):
                    keys[:, i] = [minhash.mix(own ^ np.uint64(seed)).min() for seed in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(k.view(np.int64)) for k in keys)], [*batch.schema.names, "k1", "k2", "k3"])


def distinct_texts(rows: DataFrame) -> DataFrame:
    """(text, toxic, fold) of ``rows`` without near copies; copies that are left share a fold."""
    rows = common.stored(rows.mapInArrow(_sketch, "text string, toxic long, h long, k1 long, k2 long, k3 long"), "toxic-fit")
    keys = rows.select("toxic", "h", "k1", "k2", "k3")
    for k in ("k1", "k2", "k3"):
        keys = keys.groupBy("toxic", k).agg(F.min(F.struct("h", *(x for x in ("k1", "k2", "k3") if x != k))).alias("row")).select("toxic", k, "row.*")
    out = rows.join(keys.select("toxic", "h"), ["toxic", "h"], "left_semi").select("text", "toxic", F.pmod("k1", F.lit(FOLDS)).cast("int").alias("fold"))
    kept = common.stored(out, "toxic-distinct")
    common.forget(rows)
    return kept


def _votes(words: DataFrame, cells: dict, sizes: list[tuple[int, int]]) -> DataFrame:
    """For each beginning, the distinct words that stand rather in toxic texts and those that rather stand in clean ones, by model."""
    leans = []
    for k, (n1, n0) in enumerate(sizes):
        toxic, clean = cells[1](k), cells[0](k)
        is_toxic = toxic * F.lit(float(n0)) > clean * F.lit(float(n1))
        leans += [is_toxic.cast("long").alias(f"t{k}"), (~is_toxic & (clean > 0)).cast("long").alias(f"f{k}")]
    word = F.substring("token", 1, 1_000_000)
    begins = F.array_compact(F.array(*(F.when(F.length("token") - 1 > n, F.substring(word, 1, n)) for n in BEGINS)))
    return words.select(F.explode(F.array_append(begins, F.lit(""))).alias("token"), *leans).groupBy("token").agg(*(F.sum(c).alias(c) for k in range(len(sizes)) for c in (f"t{k}", f"f{k}")))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 24_000, z: float = 2.0, prior_mass: float = 20.0, cap: float = 6.0, drift: float = 0.2, least_words: int = 5) -> Model:
    """A model from labelled rows; ``labels`` (doc_id, toxic) must hold only rows that may be learnt from."""
    rows = distinct_texts(labelled(docs, labels, sample_rows))
    sizes = {(r["fold"], r["toxic"]): r["n"] for r in rows.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = [sum(c for (_, t), c in sizes.items() if t == label) for label in (0, 1)]
    share = n[1] / max(1, sum(n))
    model = Model(drift=drift, intercept=math.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    if not all(n):
        common.forget(rows)
        return model
    cells = [f"c{c}" for c in range(2 * FOLDS)]
    counted = rows.mapInArrow(_class_counts, "token string, " + ", ".join(f"{c} long" for c in cells))
    summed = common.stored(counted.groupBy("token").agg(*(F.sum(c).alias(c) for c in cells)), "toxic-counts")
    # The last model is of all folds; each other one leaves a fold out, for that fold to be calibrated by.
    without = [*range(FOLDS), None]
    of = {label: lambda k, label=label: reduce(Column.__add__, (F.col(f"c{2 * f + label}") for f in range(FOLDS) if f != without[k])) for label in (0, 1)}
    size = [tuple(sum(c for (f, t), c in sizes.items() if t == label and f != out) for label in (1, 0)) for out in without]
    votes = common.stored(_votes(summed.where("endswith(token, ' ')"), of, size), "toxic-votes")
    every = votes.where("token = ''").first()
    of_texts = [_odds(of[1](k), of[0](k), *size[k], prior_mass, z, cap) for k in range(len(without))]
    of_words = [_odds(F.col(f"t{k}"), F.col(f"f{k}"), every[f"t{k}"], every[f"f{k}"], prior_mass, z, cap) for k in range(len(without))]
    begins = summed.join(votes, "token").select("token", *(F.when(F.col(f"t{k}") >= least_words, F.least(a, b)).alias(f"o{k}") for k, (a, b) in enumerate(zip(of_texts, of_words))))
    whole = summed.where("endswith(token, ' ')").select("token", *(o.alias(f"o{k}") for k, o in enumerate(of_texts)))
    # Bounded as the sample is: tokens with raised odds only.
    raised = F.greatest(*(F.coalesce(f"o{k}", F.lit(0.0)) for k in range(len(without)))) > 0
    got = begins.where(raised).unionByName(whole.where(raised)).collect()
    models = [Model({r["token"]: r[f"o{k}"] for r in got if (r[f"o{k}"] or 0) > 0}, drift=drift, intercept=model.intercept) for k in range(len(without))]
    above = [_odds(of[1](k), of[0](k), *size[k], prior_mass, -z, cap) for k in range(len(without))]
    surely = summed.where("endswith(token, ' ')").select("token", *((o < 0).alias(f"o{k}") for k, o in enumerate(above))).where(reduce(Column.__or__, (F.col(f"o{k}") for k in range(len(without)))))
    clean = surely.collect()
    for k, m in enumerate(models):
        m.known_clean = frozenset(w for r in clean if r[f"o{k}"] and any((w := r["token"][:-1])[:n] in m.odds for n in BEGINS))
    common.forget(summed, votes)
    model = models.pop()
    seen = rows.mapInArrow(_segment_scores(models), "toxic long, n_words long, scores array<double>").collect()
    _calibrate(model, [r["toxic"] for r in seen], [r["n_words"] for r in seen], [r["scores"] for r in seen])
    common.forget(rows)
    return model


def _calibrate(model: Model, toxic: list[int], n_words: list[int], scores: list[list[float]]) -> None:
    """Extreme-value law of clean texts' segments, then a logistic curve over the evidence of all texts."""
    clean = [k for k, t in enumerate(toxic) if not t]
    peaks = np.sort(np.array([s for k in clean for s in scores[k]]))
    total = max(1, sum(n_words[k] for k in clean))
    # The tail of the peaks; texts without one only count by their words.
    start = float(peaks[len(peaks) // 2]) if len(peaks) >= 20 else 0.0
    over = peaks[peaks >= start] - start
    # Scores are log-likelihood ratios, whose lambda is 1 in theory: one such peak stands in as a prior.
    model.lam = (len(over) + 1) / (float(over.sum()) + 1)
    model.log_k = math.log((len(over) + 0.5) / total) + model.lam * start
    label = np.array(toxic, np.float64)
    x = np.array([model.evidence(s, n) for s, n in zip(scores, n_words)])
    if not 0 < label.sum() < len(label):
        return
    a, b = model.intercept, 0.0
    for _ in range(100):  # Newton steps with a weak ridge
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -40, 40)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([np.sum(label - p), np.sum((label - p) * x) - 0.01 * b])
        h = np.array([[np.sum(w), np.sum(w * x)], [np.sum(w * x), np.sum(w * x * x) + 0.01]])
        da, db = np.linalg.solve(h + 1e-9 * np.eye(2), g)
        step = min(1.0, 1.0 / max(abs(da), abs(db), 1e-12))
        a, b = a + step * float(da), b + step * float(db)
        if max(abs(da), abs(db)) < 1e-8:
            break
    model.intercept, model.slope = a, max(0.0, b)


def score(docs: DataFrame, model: Model, significance: float = 0.05) -> DataFrame:
    """Every document's best segment, its expected number in clean text, score and passages (word places)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan(model, significance), SCORED)


def without_toxic(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``least``."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scan(model, 0.0)
        for whole in batches:
            for batch in tokens.slices(whole, at):
                numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(at)], ["doc_id", "text"])
                scores = np.concatenate([b.column(4).to_numpy() for b in scan(iter([numbered]))] or [np.empty(0)])
                yield batch.filter(pa.array(scores < least))

    return common.in_arrow(docs, run)
