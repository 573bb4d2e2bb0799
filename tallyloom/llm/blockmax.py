"""Ranked lexical search by Block-Max WAND (operator 13).

Index: each task cuts its documents into shards of ``shard_bytes`` of text and inverts one
shard at a time, so memory is bounded and no posting is shuffled.  A posting list is a row
of a Parquet table: blocks of 128 postings, gaps and counts packed at the fewest bits, and a
header for each block with its first and last document and its greatest impact.  The
impact of a posting is the score's part that depends on the document alone; it needs the
number of documents with a term and of all terms, which a first scan counts.

Search: items come in blocks of at most ``block_terms`` terms.  Shards, with the lists of the
block's terms only, are dealt to tasks.  For an item, a shallow pass over the headers sums
the greatest impacts that cover each range of documents; ranges whose sum is below the
k-th best score so far are skipped before their blocks are decompressed (a list of one
block is opened at once, so that its ranges are single documents).  In the others, those
of the greatest bound first, lists open from the weightiest down, and a block is
decompressed only while a document in it can still reach the k-th score.  The k best
stay with the task from shard to shard, so later shards are skipped more; a window over
k rows of each task makes the final ranking.  Bounds are sums of integers, so nothing
that belongs to the result can be lost.

Terms are maximal runs of letters, digits and characters beyond ASCII, with A to Z in lower
case.  Scores are 64-bit integers.  Defined results: null and empty texts have no terms;
items without terms, or whose terms stand nowhere, have no rows; rows that repeat are
documents (or items) of their own; among equal scores a null doc_id comes last; whole
texts are read, however long; other columns aren't read; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tallyloom.llm import common, tokens

BLOCK = 128
LISTS = "shard long, term binary, df int, blocks binary, data binary"
HEAD = np.dtype([("first", "<i4"), ("last", "<i4"), ("peak", "<i4"), ("at", "<i4"), ("size", "u1"), ("gap_bits", "u1"), ("tf_bits", "u1")])
IS_TERM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
FOUND = "item long, doc_id long, score long"


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Terms of texts in a row, as bytes, and the number of each one's text."""
    texts = texts.cast(pa.large_string()).cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]] if len(bounds) else np.empty(0, np.uint8)
    inside = IS_TERM[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    edges = bounds[:-1] - bounds[0] if len(bounds) else bounds
    edges = edges[edges < len(data)]
    opens[edges] = inside[edges]
    places = np.flatnonzero(opens)
    kept = LOWER[data[inside]]
    starts = (np.cumsum(inside) - 1)[places]
    offsets = np.append(starts, len(kept)).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(places), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(kept.tobytes())])
    return found, np.searchsorted(bounds - (bounds[0] if len(bounds) else 0), places, "right") - 1


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens.retire()
    n = total = 0
    for whole in batches:
        for batch in tokens.slices(whole, 0):
            _, owner = terms(batch.column(0))
            n, total = n + len(np.unique(owner)), total + len(owner)
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.int64())], ["n", "total"])


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _bits(most: np.ndarray) -> np.ndarray:
    """Bits that numbers need."""
    return np.frexp(most.astype(np.float64))[1].astype(np.uint8)


def _pack(values: np.ndarray, slot: np.ndarray, eights: np.ndarray, width: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
    """Write blocks of numbers: eight of ``width`` bits make ``width`` bytes; ``at``: where a block begins in ``out``."""
    cells = np.zeros(8 * int(eights.sum()), np.uint32)
    cells[slot] = values
    cells = cells.reshape(-1, 8)
    wide = np.repeat(width, eights)
    nth = np.arange(len(cells)) - np.repeat(np.cumsum(eights) - eights, eights)
    place = np.repeat(at, eights) + nth * wide
    for w in np.unique(width[width > 0]).tolist():
        rows, down = np.flatnonzero(wide == w), np.arange(w - 1, -1, -1, dtype=np.uint32)
        for k in range(0, len(rows), 20_000):
            own = rows[k : k + 20_000]
            bits = (cells[own][:, :, None] >> down) & 1
            out[place[own][:, None] + np.arange(w)] = np.packbits(bits.astype(np.uint8).reshape(len(own), 8 * w), axis=1)


def _unpack(data: np.ndarray, at: np.ndarray, size: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The numbers of blocks in a row, each of ``size`` numbers of ``width`` bits from byte ``at``."""
    eights = (size + 7) // 8
    out = np.zeros((int(eights.sum()), 8), np.int64)
    wide = np.repeat(width, eights)
    nth = np.arange(len(out)) - np.repeat(np.cumsum(eights) - eights, eights)
    place = np.repeat(at, eights) + nth * wide
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(wide == w)
        bits = np.unpackbits(data[place[rows][:, None] + np.arange(w)], axis=1).reshape(len(rows), 8, w)
        out[rows] = bits @ (1 << np.arange(w - 1, -1, -1, dtype=np.int64))
    return out.reshape(-1)[tokens._places(8 * (np.cumsum(eights) - eights), size)]


def invert(found: pa.Array, owner: np.ndarray, m: np.ndarray, shard: int) -> pa.RecordBatch:
    """Posting lists of a shard: its terms, each one's document (from 0), and the documents' lengths ``m``."""
    coded = found.dictionary_encode()
    n = max(1, len(m))
    key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * n + owner, return_counts=True)
    term, doc = key // n, key % n
    v = len(coded.dictionary)
    df = np.bincount(term, minlength=v)
    nth = np.arange(len(term)) - np.repeat(np.cumsum(df) - df, df)
    begin = np.flatnonzero(nth % BLOCK == 0)
    size = np.diff(np.append(begin, len(term)))
    gap = np.diff(doc, prepend=0)
    gap[begin] = 0
    head = np.zeros(len(begin), HEAD)
    if len(begin):
        head["first"], head["last"] = doc[begin], doc[begin + size - 1]
        head["peak"] = np.maximum.reduceat(impacts(tf, m[doc]), begin)
        head["size"] = size
        head["gap_bits"], head["tf_bits"] = _bits(np.maximum.reduceat(gap, begin)), _bits(np.maximum.reduceat(tf - 1, begin))
    eights = (size + 7) // 8
    n_bytes = eights * (head["gap_bits"].astype(np.int64) + head["tf_bits"])
    at = np.cumsum(n_bytes) - n_bytes
    out = np.zeros(int(n_bytes.sum()), np.uint8)
    slot = np.arange(len(term)) - np.repeat(begin, size) + np.repeat(8 * (np.cumsum(eights) - eights), size)
    _pack(gap, slot, eights, head["gap_bits"].astype(np.int64), at, out)
    _pack(tf - 1, slot, eights, head["tf_bits"].astype(np.int64), at + eights * head["gap_bits"], out)
    blocks = (df + BLOCK - 1) // BLOCK
    first = np.cumsum(blocks) - blocks
    list_at = at[first] if v else at
    head["at"] = at - np.repeat(list_at, blocks)
    binary = lambda ends, data: pa.Array.from_buffers(pa.large_binary(), v, [None, pa.py_buffer(np.append(0, ends).astype(np.int64).tobytes()), pa.py_buffer(data)]).cast(pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(v, shard)), coded.dictionary.cast(pa.binary()), pa.array(df.astype(np.int32)), binary(np.cumsum(blocks) * HEAD.itemsize, head.tobytes()), binary(np.append(list_at[1:], len(out))[:v], out.tobytes())],
        ["shard", "term", "df", "blocks", "data"],
    )


def _indexer(n: int, total: int, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, size = TaskContext.get().partitionId() << 24, 0, 0
        held: list[tuple[pa.Array, np.ndarray, pa.Array]] = []

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal seq, size
            sizes = [len(ids) for _, _, ids in held]
            owner = np.concatenate([o + k for (_, o, _), k in zip(held, np.cumsum(sizes) - sizes)])
            found = pa.concat_arrays([f for f, _, _ in held])
            ids = pa.concat_arrays([i for _, _, i in held])
            held.clear()
            m = 25 + (75 * np.bincount(owner, minlength=len(ids)) * n) // max(1, total)
            about = ids.fill_null(0).to_numpy().astype("<i8").tobytes(), m.astype("<i8").tobytes() + np.asarray(ids.is_null()).astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([part + seq]), pa.array([None], pa.binary()), pa.array([len(ids)], pa.int32()), *(pa.array([x], pa.binary()) for x in about)], ["shard", "term", "df", "blocks", "data"])
            made = invert(found, owner, m, part + seq)
            for k in range(0, made.num_rows, 50_000):
                yield made.slice(k, 50_000)
            seq, size = seq + 1, 0
            del found, owner, made
            tokens.release()

        for whole in batches:
            for batch in tokens.slices(whole, 1):
                held.append((*terms(batch.column(1)), batch.column(0)))
                size += batch.column(1).nbytes
                if size >= shard_bytes:
                    yield from settle()
        if held:
            yield from settle()

    return run


def index(docs: DataFrame, shard_bytes: int = 1 << 24) -> tuple[DataFrame, int, int]:
    """Posting lists of ``(doc_id, text)`` in the shared folder, the documents with a term, and all their terms.

    A row without a term opens its shard: the ids of its documents and their lengths.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    said = rows.select("text").mapInArrow(_counter, "n long, total long").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    n, total = said["n"] or 0, said["total"] or 0
    return common.stored(rows.mapInArrow(_indexer(n, total, shard_bytes), LISTS), "postings"), n, total


class Shard:
    """The lists of one shard that a block of items asks for, blocks decompressed when first asked for."""

    def __init__(self, about: tuple[int, bytes, bytes]):
        n, ids, rest = about
        self.ids, self.m = np.frombuffer(ids, "<i8"), np.frombuffer(rest, "<i8", n)
        self.null = np.frombuffer(rest, np.uint8, n, 8 * n).astype(bool)
        #: Blocks of each term, as places in ``heads``.
        self.terms: dict[bytes, tuple[int, int]] = {}
        self._held: list[tuple[bytes, bytes]] = []
        self._blocks = 0

    def add(self, term: bytes, blocks: bytes, data: bytes) -> None:
        n = len(blocks) // HEAD.itemsize
        self.terms[term] = self._blocks, self._blocks + n
        self._blocks += n
        self._held.append((blocks, data))

    def ready(self) -> Shard:
        """After the last list: headers in a row, and room for the postings of all blocks."""
        self.heads = np.frombuffer(b"".join(b for b, _ in self._held), HEAD)
        self.data = np.frombuffer(b"".join(d for _, d in self._held), np.uint8)
        ahead = np.cumsum([0, *(len(d) for _, d in self._held)])[:-1]
        self._held.clear()
        self.first, self.last, self.peak, self.size = (self.heads[c].astype(np.int64) for c in ("first", "last", "peak", "size"))
        counts = np.array([b - a for a, b in self.terms.values()], np.int64)
        self.at = self.heads["at"] + np.repeat(ahead, counts)
        self.place = np.cumsum(self.size) - self.size
        self.is_open = np.zeros(len(self.heads), bool)
        self.doc, self.impact = np.zeros(int(self.size.sum()), np.int64), np.zeros(int(self.size.sum()), np.int64)
        return self

    def open(self, blocks: np.ndarray) -> None:
        """Decompress those of ``blocks`` that are not open yet."""
        blocks = blocks[~self.is_open[blocks]]
        if not len(blocks):
            return
        gaps, tfs = self.heads["gap_bits"][blocks].astype(np.int64), self.heads["tf_bits"][blocks].astype(np.int64)
        size, eights = self.size[blocks], (self.size[blocks] + 7) // 8
        to = tokens._places(self.place[blocks], size)
        gap = _unpack(self.data, self.at[blocks], size, gaps)
        total = np.cumsum(gap)
        begin = np.cumsum(size) - size
        self.doc[to] = total + np.repeat(self.first[blocks] - total[begin], size)
        self.impact[to] = impacts(1 + _unpack(self.data, self.at[blocks] + eights * gaps, size, tfs), self.m[self.doc[to]])
        self.is_open[blocks] = True

    def search(self, asked: list[tuple[bytes, int]], least: int, k: int, at_once: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """Documents (from 0) and scores that may be among the k best, given the k-th best score so far.

        ``asked``: terms and their weights; ``at_once``: documents of the first round, four times
        as many in each one after.  Documents below ``least`` and with a score of 0 are left out.
        """
        here = [(*self.terms[t], w) for t, w in asked if w > 0 and t in self.terms]
        begin, end, weights = (np.array(x, np.int64) for x in (zip(*here) if here else ((), (), ())))
        blocks, weight, alone = tokens._places(begin, end - begin), np.repeat(weights, end - begin), np.repeat(end - begin == 1, end - begin)
        # A list of one block is opened at once: its pointer stands on single documents.
        self.open(blocks[alone])
        sure = tokens._places(self.place[blocks[alone]], self.size[blocks[alone]])
        sure_doc, sure_score = self.doc[sure], self.impact[sure] * np.repeat(weight[alone], self.size[blocks[alone]])
        blocks, weight = blocks[~alone], weight[~alone]
        first, last = self.first[blocks], self.last[blocks]
        # Shallow moves: greatest impacts of the blocks over each document, none of them decompressed.  Sums stay below 2**53.
        n = len(self.ids)
        peak = self.peak[blocks] * weight
        over = np.bincount(first, peak, n + 1) - np.bincount(last + 1, peak, n + 1)
        exact = np.bincount(sure_doc, sure_score, n)
        bound = np.rint(np.cumsum(over)[:n]) + exact
        least = max(least, 1)
        rest = np.flatnonzero(bound >= least)
        docs = scores = np.empty(0, np.int64)
        while len(rest):
            if len(rest) > at_once:
                order = np.argpartition(-bound[rest], at_once)
                now, rest = rest[order[:at_once]], rest[order[at_once:]]
            else:
                now, rest = rest, rest[:0]
            at_once *= 4
            wanted = np.zeros(n + 1, np.int64)
            wanted[now + 1] = 1
            upto = np.cumsum(wanted)
            needed = upto[last + 1] > upto[first]
            self.open(blocks[needed])
            own = tokens._places(self.place[blocks[needed]], self.size[blocks[needed]])
            gain = np.repeat(weight[needed], self.size[blocks[needed]])
            hit = wanted[self.doc[own] + 1] == 1
            score = exact + np.bincount(self.doc[own[hit]], self.impact[own[hit]] * gain[hit], n)
            found = np.rint(score[now]).astype(np.int64)
            fine = found >= least
            docs, scores = np.append(docs, now[fine]), np.append(scores, found[fine])
            if len(scores) >= k:
                least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                docs, scores = docs[scores >= least], scores[scores >= least]
                rest = rest[bound[rest] >= least]
        return docs, scores


def _searcher(items: list[list[tuple[bytes, int]]], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64),) * 3] * len(items)

        def settle(shard: Shard) -> None:
            for number, asked in enumerate(items):
                score, null, ids = best[number]
                docs, found = shard.search(asked, int(score[-1]) if len(score) == k else 0, k)
                if len(docs):
                    score, null, ids = np.append(score, found), np.append(null, shard.null[docs]), np.append(ids, shard.ids[docs])
                    order = np.lexsort((ids, null, -score))[:k]
                    best[number] = score[order], null[order], ids[order]

        shard, now = None, None
        for batch in batches:
            number, term, df, blocks, data = (c.to_pylist() for c in batch.columns)
            for s, t, n, b, d in zip(number, term, df, blocks, data):
                if s != now:
                    if shard is not None:
                        settle(shard.ready())
                    shard, now = Shard((n, b, d)), s
                else:
                    shard.add(t, b, d)
        if shard is not None:
            settle(shard.ready())
        sizes = [len(s) for s, _, _ in best]
        score, null, ids = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (zip(*best) if best else ((), (), ())))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(best)), sizes)), pa.array(ids, pa.int64(), mask=null.astype(bool)), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("term", pa.binary()), ("n", pa.int32())]))
    for whole in batches:
        for batch in tokens.slices(whole, 1):
            found, owner = terms(batch.column(1))
            counts = [Counter() for _ in range(batch.num_rows)]
            for t, o in zip(found.to_pylist(), owner.tolist()):
                counts[o][t] += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[{"term": t, "n": n} for t, n in c.items()] for c in counts], kind)], ["item_id", "terms"])


def _in_blocks(rows: Iterator, block_terms: int) -> Iterator[list]:
    held, size = [], 0
    for r in rows:
        if held and size + len(r["terms"]) > block_terms:
            yield held
            held, size = [], 0
        held.append(r)
        size += len(r["terms"])
    if held:
        yield held


def rank(postings: DataFrame, n: int, items: DataFrame, k: int = 10, block_terms: int = 200_000) -> DataFrame:
    """The k best documents of each item ``(item_id, text)``: item_id, rank, doc_id, score.

    ``postings`` and ``n`` come from :func:`index`.  One block of items is live at a time, on
    the driver and in tasks; each block's rows are written before the next.
    """
    spark = postings.sparkSession
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    asked = rows.mapInArrow(_item_terms, "item_id long, terms array<struct<term: binary, n: int>>").where("size(terms) > 0")
    out = common.work_dir(spark, "ranked")
    schema = "item_id long, rank int, doc_id long, score long"
    spark.createDataFrame([], schema).write.parquet(out)
    for block in _in_blocks(asked.toLocalIterator(), block_terms):
        wanted = spark.createDataFrame([(bytearray(t),) for t in sorted({bytes(x["term"]) for r in block for x in r["terms"]})], "term binary")
        # The block's terms: block_terms bounds them.
        lists = postings.join(F.broadcast(wanted), "term", "left_semi")
        held = {bytes(r["term"]): r["df"] for r in lists.groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator()}
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for t, df in held.items()}
        queries = [[(t, x["n"] * weight[t]) for x in r["terms"] if (t := bytes(x["term"])) in weight] for r in block]
        dealt = lists.unionByName(postings.where("term IS NULL")).select(*[c.split()[0] for c in LISTS.split(", ")])
        dealt = dealt.repartition("shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first())
        found = dealt.mapInArrow(_searcher(queries, k), FOUND)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], "item long, item_id long")
        top.join(ids, "item").select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)
