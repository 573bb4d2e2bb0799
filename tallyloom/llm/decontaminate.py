"""Benchmark decontamination by greedy string tiling (operator 7).

A document and a benchmark item are candidates when they share a seed of ``seed``
words.  Running Karp-Rabin: seed hashes of a whole batch of documents are looked up in
the sorted seed hashes of the items; equal seeds on one diagonal grow into matches.
Tiles are set greedily: all longest matches that overlap no tile yet are marked, then
the next shorter ones, down to ``seed`` words.  The share of the item's words under tiles
is its coverage, so a passage whose sentences were reordered counts as a copied one does.

The benchmark is the stated query set.  Items that are equal word for word become one in
Spark; the rest is cut into blocks whose words are counted first, at most ``block_words``
each unless a single one of ``CELLS`` hash cells of items has more.  One block at a time
goes to all tasks and the documents are scanned once a block; no document moves.

Words are lower-case runs of letters and digits.  Defined results: items that are equal
word for word count once, under their least item_id; an item of fewer than ``seed`` words
is its own seed, found where all its words stand in a row; items without words and null
or empty texts match nothing; very long texts are tiled whole; repeated rows give repeated
rows; other columns are not read, and ``without_contaminated`` keeps them whatever their
names; an empty table on either side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyloom.llm import common, minhash, tokens, toxicity

HITS = "doc_id long, item_id long, coverage double, item_words int, tiles array<struct<doc_word:int,item_word:int,length:int>>"


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in a row, and where each text's words begin."""
    values, at = toxicity.words_of(texts)
    coded = values.dictionary_encode()
    vocabulary = np.array(coded.dictionary.to_pylist(), dtype=object)
    own = pd.util.hash_array(vocabulary, categorize=False) if len(vocabulary) else np.empty(0, np.uint64)
    return own[coded.indices.to_numpy()], at


def seeds_of(words: np.ndarray, size: int) -> np.ndarray:
    return minhash.shingles(words, size) if len(words) >= size else np.empty(0, np.uint64)


#: Hash cells whose words are counted before the benchmark is cut into blocks.
CELLS = 4096


@dataclass
class Block:
    """Items of one block: their words in a row, and all seeds in order of hash; items shorter than a seed by length."""

    item_ids: list[int | None]
    words: np.ndarray
    begins: np.ndarray
    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray
    #: For each length, (hashes in order, item of each).
    short: dict[int, tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def of(item_ids: list, texts: list, size: int) -> Block:
        words, at = hashed_words(pa.array(texts, pa.string()))
        own = [words[a:b] for a, b in zip(at[:-1], at[1:])]
        begins = np.cumsum([0] + [len(x) for x in own])
        long = [k for k, x in enumerate(own) if len(x) >= size]
        gather = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        hashes = gather([seeds_of(own[k], size) for k in long], np.uint64)
        item = gather([np.full(len(own[k]) - size + 1, k) for k in long], np.int64)
        place = gather([np.arange(len(own[k]) - size + 1) for k in long], np.int64)
        order = np.argsort(hashes, kind="stable")
        short = {}
        for n in {len(x) for x in own if 0 < len(x) < size}:
            mine = np.array([k for k, x in enumerate(own) if len(x) == n])
            keys = np.array([minhash.shingles(own[k], n)[0] for k in mine], np.uint64)
            short[n] = keys[np.argsort(keys)], mine[np.argsort(keys)]
        return Block(item_ids, words, begins, hashes[order], item[order], place[order], short)

    def words_of(self, item: int) -> np.ndarray:
        return self.words[self.begins[item] : self.begins[item + 1]]

    def short_hits(self, words: np.ndarray, at: np.ndarray):
        """(document, place, item) of items shorter than a seed in texts that begin at ``at``, each once a text."""
        for n, (keys, items) in self.short.items():
            grams = seeds_of(words, n)
            low, high = np.searchsorted(keys, grams, "left"), np.searchsorted(keys, grams, "right")
            met = set()
            for i in np.flatnonzero(high > low).tolist():
                d = int(np.searchsorted(at, i, "right")) - 1
                for own in items[low[i] : high[i]].tolist():
                    if i + n <= at[d + 1] and (d, own) not in met and np.array_equal(words[i : i + n], self.words_of(own)):
                        met.add((d, own))
                        yield d, i - int(at[d]), own


def tile(i: np.ndarray, j: np.ndarray, n_doc: int, n_item: int, size: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (document word, item word, length) from the pairs of equal seeds."""
    order = np.lexsort((i, i - j))
    i, j = i[order], j[order]
    doc_free, item_free = np.ones(n_doc, bool), np.ones(n_item, bool)
    out = []
    while len(i):
        fresh = np.flatnonzero(np.append(True, (np.diff(i) != 1) | (np.diff(j) != 1)))
        lengths = np.diff(np.append(fresh, len(i))) + size - 1
        longest = int(lengths.max())
        best = fresh[lengths == longest]
        for k in best[np.lexsort((i[best], j[best]))].tolist():
            a, b = int(i[k]), int(j[k])
            if doc_free[a : a + longest].all() and item_free[b : b + longest].all():
                doc_free[a : a + longest] = item_free[b : b + longest] = False
                out.append((a, b, longest))
        doc_used, item_used = np.cumsum(np.append(0, ~doc_free)), np.cumsum(np.append(0, ~item_free))
        free = (doc_used[i + size] == doc_used[i]) & (item_used[j + size] == item_used[j])
        i, j = i[free], j[free]
    return out


def matches(words: np.ndarray, block: Block, least: float, size: int) -> Iterator[tuple[int, float, list]]:
    """(item of the block, coverage, tiles) of every item that a text covers enough."""
    seeds = seeds_of(words, size)
    low = np.searchsorted(block.hashes, seeds, "left")
    counts = np.searchsorted(block.hashes, seeds, "right") - low
    at = np.flatnonzero(counts)
    if not len(at):
        return
    n = counts[at]
    post = np.repeat(low[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    i, item, j = np.repeat(at, n), block.item[post], block.place[post]
    same = np.ones(len(i), bool)
    for k in range(size):
        same &= words[i + k] == block.words[block.begins[item] + j + k]
    i, item, j = i[same], item[same], j[same]
    order = np.argsort(item, kind="stable")
    i, item, j = i[order], item[order], j[order]
    edges = np.flatnonzero(np.append(True, np.diff(item) != 0)) if len(item) else []
    for a, b in zip(edges, [*edges[1:], len(item)]):
        own = int(item[a])
        total = len(block.words_of(own))
        touched = np.zeros(total + 1, np.int64)
        places = np.unique(j[a:b])
        np.add.at(touched, places, 1)
        np.add.at(touched, places + size, -1)
        if np.count_nonzero(np.cumsum(touched)[:total]) < least * total:
            continue  # no tiling can cover more than all shared seeds do
        tiles = tile(i[a:b], j[a:b], len(words), total, size)
        coverage = sum(t[2] for t in tiles) / total
        if coverage >= least:
            yield own, coverage, tiles


def _scan(shared, least: float, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.retire()
        block: Block = shared.value
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.list_(pa.struct([("doc_word", pa.int32()), ("item_word", pa.int32()), ("length", pa.int32())]))]
        for whole in batches:
            for batch in tokens.slices(whole, 1):
                words, at = hashed_words(batch.column(1))
                ids = batch.column(0).to_pylist()
                # Most texts share nothing: one lookup of the whole slice finds those that may.
                grams = seeds_of(words, size) if len(block.hashes) else np.empty(0, np.uint64)
                place = np.searchsorted(block.hashes, grams)
                hit = np.flatnonzero(block.hashes[np.minimum(place, len(block.hashes) - 1)] == grams) if len(grams) else grams.astype(np.int64)
                rows = []
                for d in np.unique(np.searchsorted(at, hit, "right") - 1).tolist():
                    for own, coverage, tiles in matches(words[at[d] : at[d + 1]], block, least, size):
                        rows.append((ids[d], block.item_ids[own], coverage, len(block.words_of(own)), [dict(zip(("doc_word", "item_word", "length"), t)) for t in tiles]))
                for d, i, own in block.short_hits(words, at):
                    n = len(block.words_of(own))
                    rows.append((ids[d], block.item_ids[own], 1.0, n, [{"doc_word": i, "item_word": 0, "length": n}]))
                columns = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "coverage", "item_words", "tiles"])

    return run


def _normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in tokens.slices(whole, 1):
            words, at = toxicity.words_of(batch.column(1))
            own = [" ".join(words.slice(int(a), int(b - a)).to_pylist()) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.string()), pa.array(np.diff(at).astype(np.int64))], ["item_id", "words", "n"])


def _blocks(benchmark: DataFrame, seed: int, block_words: int) -> Iterator[tuple[Block, bool]]:
    """Blocks of ``(item_id, text)`` items of bounded size, and whether each is the last."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_normal, "item_id long, words string, n long").where("n > 0")
    items = items.groupBy("words", "n").agg(F.min("item_id").alias("item_id")).withColumn("cell", F.pmod(F.xxhash64("words"), F.lit(CELLS)).cast("int"))
    items = common.stored(items, "benchmark")
    # At most a row for each cell passes to the driver before the blocks do, one at a time.
    counts = sorted((r["cell"], r["n"]) for r in items.groupBy("cell").agg(F.sum("n").alias("n")).collect())
    ranges: list[list[int]] = []
    for cell, n in counts:
        if ranges and ranges[-1][2] + n <= block_words:
            ranges[-1][1:] = [cell, ranges[-1][2] + n]
        else:
            ranges.append([cell, cell, n])
    for k, (low, high, _) in enumerate(ranges):
        own = items.where(F.col("cell").between(low, high)).select("item_id", "words").collect()
        own.sort(key=lambda r: r["words"])
        yield Block.of([r["item_id"] for r in own], [r["words"] for r in own], seed), k == len(ranges) - 1
    common.forget(items)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, seed: int = 5, block_words: int = 2_000_000) -> DataFrame:
    """A row for each document ``(doc_id, text)`` and item ``(item_id, text)`` that it covers by ``least``."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = []
    for block, last in _blocks(benchmark, seed, block_words):
        shared = spark.sparkContext.broadcast(block)
        hits = rows.mapInArrow(_scan(shared, least, seed), HITS)
        if not last:  # only one block is held at a time
            hits = common.stored(hits, "hits")
            shared.destroy()
        found.append(hits)
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], HITS)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, seed: int = 5, block_words: int = 2_000_000) -> DataFrame:
    """The rows of ``docs``, all columns, that cover no item by ``least``; a scan a block, each of what the one before left."""
    at = docs.columns.index("text")

    def clean(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scan = _scan(shared, least, seed)
            for whole in batches:
                for batch in tokens.slices(whole, at):
                    numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(at)], ["doc_id", "text"])
                    keep = np.ones(batch.num_rows, bool)
                    for b in scan(iter([numbered])):
                        keep[b.column(0).to_numpy()] = False
                    yield batch.filter(pa.array(keep))

        return run

    behind = None
    for block, last in _blocks(benchmark, seed, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        docs = common.in_arrow(docs, clean(shared))
        if not last:  # only one block is held at a time
            docs = common.stored(docs, "uncontaminated")
            shared.destroy()
            if behind is not None:
                common.forget(behind)
            behind = docs
    return docs
