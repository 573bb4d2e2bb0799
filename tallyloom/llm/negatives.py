"""Hard-negative mining by product quantisation with stored residual norms (operator 12).

Components become integers, floor(scale * x), so all scores are exact.  A vector is cut into
subspaces of ``width`` components; each is replaced by the nearest of at most 256 integer
centroids, fitted on a sample of ``sample_rows`` rows (those of least id hash), and the
length of what is left is stored for each of ``groups`` groups of subspaces, rounded up.
For an anchor, a table of its products with all centroids gives every row's score without
the residual, and the residual adds at most the sum over groups of the product of the two
lengths (Cauchy and Schwarz).  So a row that can't come in is ruled out without reading
its vector, rigorously; those left are scored on the integer vectors.  Recall is 1 for
any sample; the sample only decides how many rows are scored.

Anchors are a stated query set against all rows, in blocks of ``block`` anchors.  A block
takes two scans of the index: its positives (the best rows of its label), then for each
positive the window of scores that a hard negative may have.  A task keeps the best rows
of each anchor or window, which also raises what later rows must reach, and sends those
only: no shuffle grows with the rows, and hot labels or equal vectors don't matter.

Defined results: rows without id, label or vector, or with a null or non-finite component
take no part; shorter vectors count as filled with zeros; equal scores go by id; rows
that share the anchor's id are not among its rows, other rows that repeat each count;
repeated anchors have rows each; a component beyond 2**22 after scaling is an error, as
scores would no longer be exact; other columns, whatever their names, are not read; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyloom.llm import common

INDEX = "id long, label long, codes binary, rest binary, vector binary"
LIMIT = 1 << 22
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def integers(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """``(id, label, vector)`` of the rows that take part, components as integers."""
    name = lambda c: F.col(f"`{c.replace('`', '``')}`")
    rows = vectors.select(name(id).cast("long").alias("id"), name(label).cast("long").alias("label"), name(vector).cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    small = F.forall("vector", lambda x: F.abs(x * scale) < LIMIT)
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & fine)
    whole = F.transform("vector", lambda x: F.floor(x * scale))
    return rows.withColumn("vector", F.when(small, whole).otherwise(F.raise_error(F.lit(f"a component is beyond {LIMIT} after scaling"))))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of integers as rows of ``dim`` components."""
    sizes = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy().astype(np.float64)
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(column), dim))
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


class Quantiser:
    """Integer centroids of every subspace; vectors are filled up with zeros to whole subspaces."""

    def __init__(self, books: np.ndarray, dim: int, groups: int):
        self.books, self.dim = books, dim
        self.n, self.k, self.width = books.shape
        self.edges = np.linspace(0, self.n, min(groups, self.n) + 1).astype(int)

    @staticmethod
    def fit(sample: np.ndarray, width: int, groups: int, rounds: int = 8) -> Quantiser:
        """Lloyd's iterations in every subspace, from sample rows spread along the first axis."""
        rows, dim = sample.shape
        n = max(1, -(-dim // width))
        parts = np.pad(sample, ((0, 0), (0, n * width - dim))).reshape(rows, n, width)
        books = []
        for m in range(n):
            points = parts[:, m]
            seeds = np.unique(points, axis=0)
            book = seeds[np.linspace(0, len(seeds) - 1, min(256, len(seeds))).astype(int)]
            for _ in range(rounds if len(seeds) > 256 else 0):
                near = _nearest(points, book)
                count = np.bincount(near, minlength=len(book))
                sums = np.stack([np.bincount(near, points[:, d], len(book)) for d in range(width)], 1)
                book = np.where(count[:, None] > 0, np.rint(sums / np.maximum(count, 1)[:, None]), book)
            books.append(np.concatenate([book, np.repeat(book[:1], 256 - len(book), 0)]))
        return Quantiser(np.stack(books), dim, groups)

    def split(self, vectors: np.ndarray) -> np.ndarray:
        return np.pad(vectors, ((0, 0), (0, self.n * self.width - vectors.shape[1]))).reshape(len(vectors), self.n, self.width)

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the residual's length in each group, rounded up."""
        parts = self.split(vectors)
        codes = np.stack([_nearest(parts[:, m], self.books[m]) for m in range(self.n)], 1).astype(np.uint8)
        square = ((parts - self.books[np.arange(self.n), codes]) ** 2).sum(2)
        return codes, (np.sqrt(np.add.reduceat(square, self.edges[:-1], axis=1)) * (1 + 1e-6)).astype(np.float32)

    def tables(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Products of anchors with all centroids (subspace, centroid, anchor), and their lengths in each group."""
        parts = self.split(anchors)
        products = np.einsum("mkw,amw->mka", self.books, parts)
        lengths = np.sqrt(np.add.reduceat((parts**2).sum(2), self.edges[:-1], axis=1)) * (1 + 1e-6)
        return products, lengths.T

    def bounds(self, codes: np.ndarray, rest: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of rows (down) and anchors (across) without the residual, and how far off they may be."""
        products, lengths = tables
        score = np.take(products[0], codes[:, 0], axis=0)
        for m in range(1, self.n):
            score += np.take(products[m], codes[:, m], axis=0)
        return score, rest.astype(np.float64) @ lengths


def _nearest(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    square = (book**2).sum(1)
    return np.concatenate([(square - 2 * (points[k : k + 4096] @ book.T)).argmin(1) for k in range(0, len(points), 4096)]) if len(points) else np.empty(0, np.int64)


def _encoder(quantiser: Quantiser):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 4096):
                batch = whole.slice(k, 4096)
                vectors = _matrix(batch.column(2), quantiser.dim)
                codes, rest = quantiser.encode(vectors)
                blob = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), blob(codes), blob(rest), blob(vectors.astype("<i4"))], ["id", "label", "codes", "rest", "vector"])

    return run


def index(vectors: DataFrame, sample_rows: int = 4096, width: int = 2, groups: int = 4) -> tuple[DataFrame, Quantiser]:
    """Codes, residual lengths and integer vectors of all rows of :func:`integers`, in the shared folder."""
    dim = vectors.agg(F.max(F.size("vector"))).first()[0] or 0
    sample = vectors.orderBy(F.xxhash64("id"), "id").select("vector").limit(sample_rows).toArrow().column(0).combine_chunks()
    quantiser = Quantiser.fit(_matrix(sample, max(1, dim)) if len(sample) else np.zeros((1, max(1, dim))), width, groups)
    return common.stored(vectors.select("id", "label", "vector").mapInArrow(_encoder(quantiser), INDEX), "quantised"), quantiser


def _rows(batches: Iterator[pa.RecordBatch], quantiser: Quantiser) -> Iterator[tuple[np.ndarray, ...]]:
    """Ids, labels, codes, residual lengths and vectors, a few thousand rows at a time."""
    for whole in batches:
        for k in range(0, whole.num_rows, 4096):
            batch = whole.slice(k, 4096)
            blob = lambda c, kind: np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).reshape(batch.num_rows, -1)  # noqa: E731, B023
            yield batch.column(0).to_numpy(), batch.column(1).to_numpy(), blob(2, np.uint8), blob(3, "<f4"), blob(4, "<i4").astype(np.float64)


class Best:
    """The ``k`` best (score, id) of each of ``n`` owners."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.owner, self.score, self.id = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        #: What a row must reach to come in.
        self.least = np.full(n, -np.inf)

    def add(self, owner: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        owner, score, ids = np.append(self.owner, owner), np.append(self.score, score), np.append(self.id, ids)
        order = np.lexsort((ids, -score, owner))
        owner = owner[order]
        nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
        kept = nth < self.k
        self.owner, self.score, self.id = owner[kept], score[order][kept], ids[order][kept]
        full = nth[kept] == self.k - 1
        self.least[self.owner[full]] = self.score[full]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.owner), pa.array(self.score.astype(np.int64)), pa.array(self.id)], ["owner", "score", "id"])


FOUND = "owner long, score long, id long"


def _positives(quantiser: Quantiser, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, k: int, at_once: int):
    """Each anchor's ``k`` best rows of its label, as far as one task sees them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(labels, kind="stable")
        cuts = [0, *(np.flatnonzero(np.diff(labels[order])) + 1).tolist(), len(order)]
        sets = [order[a : min(a + at_once, b)] for i, b in zip(cuts, cuts[1:]) for a in range(i, b, at_once)]
        best = Best(len(ids), k)
        for row_id, label, codes, rest, whole in _rows(batches, quantiser):
            by_label = np.argsort(label, kind="stable")
            sorted_labels = label[by_label]
            for anchors in sets:
                lo, hi = np.searchsorted(sorted_labels, labels[anchors[0]]), np.searchsorted(sorted_labels, labels[anchors[0]], "right")
                if lo == hi:
                    continue
                rows = by_label[lo:hi]
                score, off = quantiser.bounds(codes[rows], rest[rows], quantiser.tables(vectors[anchors]))
                off[row_id[rows][:, None] == ids[anchors]] = -np.inf
                upper, lower = score + off, score - np.abs(off)
                least = best.least[anchors]
                if len(rows) >= k:
                    least = np.maximum(least, np.partition(lower, len(rows) - k, axis=0)[len(rows) - k])
                r, a = np.nonzero((upper >= least) & (upper > -np.inf))
                best.add(anchors[a], (whole[rows[r]] * vectors[anchors[a]]).sum(1), row_id[rows[r]])
        yield best.batch()

    return run


def _negatives(quantiser: Quantiser, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, windows: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, at_once: int):
    """The ``k`` best rows of another label in each window (anchor, least, most), as far as one task sees them."""
    of, low, high = windows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(of), k)
        begin, end = np.searchsorted(of, np.arange(len(ids))), np.searchsorted(of, np.arange(len(ids)), "right")
        asked = np.flatnonzero(end > begin)
        most = np.full(len(ids), -np.inf)
        np.maximum.at(most, of, high)
        sets = [asked[a : a + at_once] for a in range(0, len(asked), at_once)]
        for row_id, label, codes, rest, whole in _rows(batches, quantiser):
            for anchors in sets:
                score, off = quantiser.bounds(codes, rest, quantiser.tables(vectors[anchors]))
                least = np.full(len(ids), np.inf)
                np.minimum.at(least, of, np.maximum(low, best.least))
                r, a = np.nonzero((score + off >= least[anchors]) & (score - off <= most[anchors]) & (label[:, None] != labels[anchors]))
                exact = (whole[r] * vectors[anchors[a]]).sum(1)
                each = (end - begin)[anchors[a]]
                pair = np.repeat(np.arange(len(r)), each)
                window = begin[anchors[a]][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each)
                fits = (exact[pair] <= high[window]) & (exact[pair] >= np.maximum(low, best.least)[window])
                best.add(window[fits], exact[pair][fits], row_id[r[pair[fits]]])
        yield best.batch()

    return run


def _merged(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("owner").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(anchors: DataFrame, block: int) -> Iterator[list]:
    held = []
    for r in anchors.toLocalIterator():
        held.append(r)
        if len(held) == block:
            yield held
            held = []
    if held:
        yield held


def mine(rows: DataFrame, quantiser: Quantiser, anchors: DataFrame, positives: int = 5, negatives: int = 5, percent: int = 80, block: int = 2048, at_once: int = 64) -> DataFrame:
    """Hard negatives of ``anchors``, which are rows of the index.

    For each anchor and each of its ``positives`` best rows of the same label: the
    ``negatives`` best rows of another label that score at most as the positive and at least
    ``percent`` hundredths of it.
    """
    spark = rows.sparkSession
    out = common.work_dir(spark, "mined")
    spark.createDataFrame([], MINED).write.parquet(out)
    for held in _blocks(anchors.select("id", "label", "vector"), block):
        ids, labels = np.array([r["id"] for r in held]), np.array([r["label"] for r in held])
        vectors = np.frombuffer(b"".join(bytes(r["vector"]) for r in held), "<i4").reshape(len(held), -1).astype(np.float64)
        own = _merged(rows.mapInArrow(_positives(quantiser, ids, labels, vectors, positives, at_once), FOUND), positives)
        pairs = sorted((r["owner"], r["rank"], r["id"], r["score"]) for r in own.collect())  # at most block * positives rows
        pairs = [p for p in pairs if p[3] >= 0]  # no score lies between a negative one and a larger part of it
        if not pairs:
            continue
        of, _, positive, score = (np.array(x) for x in zip(*pairs))
        windows = of, -(-percent * score // 100).astype(np.float64), score.astype(np.float64)
        found = _merged(rows.mapInArrow(_negatives(quantiser, ids, labels, vectors, windows, negatives, at_once), FOUND), negatives)
        named = spark.createDataFrame([(i, int(ids[a]), int(p), int(s)) for i, (a, p, s) in enumerate(zip(of, positive, score))], "owner long, anchor_id long, positive_id long, positive_score long")
        found.select("owner", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, "owner").select(*[c.split()[0] for c in MINED.split(", ")]).write.mode("append").parquet(out)
    return spark.read.schema(MINED).parquet(out)
