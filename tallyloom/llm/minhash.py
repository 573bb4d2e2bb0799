"""Near-duplicate classes by ProbMinHash, banding and verification (operator 3).

Words are lower-case runs between white space; shingles are five words (a text of
fewer words is one shingle).  ProbMinHash: each shingle sends arrivals of a Poisson
process whose rate is its weight, each arrival falls on one of the signature's registers,
and the earliest arrival at a register names its shingle; arrivals after a horizon by
which all registers are filled are never made (texts with a register still empty get a
later horizon).  Registers of two texts agree with their probability Jaccard similarity.
Links are verified on shingle sets, so every shingle weighs 1, however often a text
repeats it: registers then agree with the very similarity that is verified.

Steps, each a Spark job over all rows:

1. one scan gives each row a node (a 128-bit hash of its words, so equal texts are one
   node from here on) and one hash a band;
2. nodes meet in buckets; a second scan gives shingle sets and bitmaps of them for the
   nodes that meet another.  It finds their rows by a bitmap of fixed size over all rows
   (rows that only hash alike are told apart by their nodes), so no text is shuffled;
3. each bucket proposes its least node with every other.  A pair whose bitmaps rule out
   the similarity is dropped: A and B share at most |A| less the bits that only A has.
   Others are verified by the exact Jaccard similarity of their shingle sets;
4. connected components of the links;
5. only buckets that still hold several components go on: more of their nodes become
   centres, each is verified against the members of other components, and leaves.
   When a bucket has one component or no member is left, each of its pairs is verified,
   ruled out or already joined.  So no bucket is capped and no bucket sends all pairs.

Result: one row per input row with its class, the least doc_id of it.

Defined results: texts that are equal word for word (any case) are one class; texts
without words are one class with those of equal text, null apart from empty; null doc_ids
stay in the result and never name a class unless it has no other id; rows that repeat
are repeated; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.llm import common, components, tokens

#: Longs of a node's bitmap.
WORDS = 16
#: Rows of about 250 bytes that may be broadcast.
MOST_SENT = 200_000
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * M1
        x = (x ^ (x >> np.uint64(27))) * M2
        return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in a row, and where each text's words begin."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    coded = lists.values.dictionary_encode()
    vocabulary = np.array(coded.dictionary.to_pylist(), dtype=object)
    own = pd.util.hash_array(vocabulary, categorize=False) if len(vocabulary) else np.empty(0, np.uint64)
    index = coded.indices.to_numpy()
    hashes = own[index]
    blank = np.flatnonzero(vocabulary == "")
    if len(blank):
        gone = index == blank[0]
        at = at - np.concatenate([[0], np.cumsum(gone)])[at]
        hashes = hashes[~gone]
    return hashes, at


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every shingle of one text, in order."""
    if len(words) == 0:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - size + 1)
    with np.errstate(over="ignore"):
        total = np.full(n, min(len(words), size), np.uint64)
        for j in range(min(len(words), size)):
            total = (total + words[j : j + n]) * (GOLDEN | np.uint64(1)) + np.uint64(j)
            total ^= total >> np.uint64(29)
    return mix(total)


def probminhash(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """Signatures (n_docs x registers) of weighted elements; every document must have one."""
    total = np.bincount(doc, weight, n_docs)
    signature = np.zeros(n_docs * registers, np.uint64)
    first = np.full(n_docs * registers, np.inf)
    horizon = registers * (math.log(registers) + 4) / np.maximum(total, 1e-9)
    todo = np.ones(n_docs, bool)
    while todo.any():
        mine = todo[doc]
        d, k, w = doc[mine], key[mine], weight[mine]
        h, step = np.zeros(len(d)), 0
        while len(d):
            with np.errstate(over="ignore"):
                bits = mix(k + np.uint64(step + 1) * GOLDEN)
            h = h - np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / w
            keep = h < horizon[d]
            d, k, w, h, bits = d[keep], k[keep], w[keep], h[keep], bits[keep]
            place = d * registers + (mix(bits ^ GOLDEN) % np.uint64(registers)).astype(np.int64)
            np.minimum.at(first, place, h)
            won = first[place] == h
            signature[place[won]] = k[won]
            step += 1
        todo &= np.isinf(first.reshape(n_docs, registers)).any(axis=1)
        horizon[todo] *= 4
    return signature.reshape(n_docs, registers)


SIGNED = ["doc_id", "text_hash", "node", "bands"]
#: Bits of the filter that finds the rows whose shingles are read (8 MB, whatever the input).
FILTER_BITS = 1 << 26


def _node(words: np.ndarray, text: str | None) -> bytes:
    """Key of a text: a hash of its words; one without words is equal only to the same text."""
    import xxhash

    return xxhash.xxh3_128_digest(words.tobytes() if len(words) else b"null" if text is None else b"blank" + text.encode())


def _signer(bands: int, rows: int, size: int, least: float):
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.retire()
        for whole in batches:
            for batch in tokens.slices(whole, 1, 2_000_000):
                words, at = word_hashes(batch.column(1))
                nodes, sets, out = [], [], []
                for i in range(batch.num_rows):
                    own = words[at[i] : at[i + 1]]
                    nodes.append(_node(own, None if len(own) else batch.column(1)[i].as_py()))
                    key = np.unique(shingles(own, size))
                    # A set so small that one more shingle parts it from its like is similar only to equal ones.
                    tiny = len(key) * (1 - least) < least - 1e-9
                    out.append(np.array([xxhash.xxh3_64_intdigest(key.tobytes(), seed=1)] if tiny and len(key) else [], np.uint64).view(np.int64))
                    sets.append(key[:0] if tiny else key)
                sizes = np.array([len(x) for x in sets], np.int64)
                full = np.flatnonzero(sizes)
                if len(full):
                    doc = np.repeat(np.arange(len(full)), sizes[full])
                    signature = probminhash(doc, np.concatenate([sets[i] for i in full]), np.ones(len(doc)), len(full), bands * rows)
                    with np.errstate(over="ignore"):
                        hashed = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN, (len(full), 1))
                        for r in range(rows):
                            hashed = mix(hashed + signature[:, r::rows])
                    for row, i in zip(hashed.view(np.int64), full):
                        out[i] = row
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array(nodes, pa.binary()), pa.array(out, pa.list_(pa.int64()))], SIGNED)

    return run


def _filter_of(places: DataFrame) -> np.ndarray:
    """A bitmap of ``place`` (0 to FILTER_BITS - 1): at most one row for each long of it passes to the driver."""
    bit = F.expr("shiftleft(cast(1 as bigint), cast(place % 64 as int))")
    out = np.zeros(FILTER_BITS // 64, np.int64)
    longs = places.groupBy(F.floor(F.col("place") / 64).cast("int").alias("at")).agg(F.bit_or(bit).alias("bits")).toPandas()
    out[longs["at"].to_numpy(np.int64)] = longs["bits"].to_numpy(np.int64)
    return out


def _shingle_sets(size: int, wanted):
    """node, size, bitmap and shingles of rows (place, text) whose place is in the filter ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = wanted.value
        for batch in batches:
            place = batch.column(0).to_numpy()
            own = batch.filter(pa.array((held[place >> 6] >> (place & 63)) & 1 == 1))
            for part in tokens.slices(own, 1):
                words, at = word_hashes(part.column(1))
                nodes, sizes, bitmaps, sets = [], [], [], []
                for i in range(part.num_rows):
                    one = words[at[i] : at[i + 1]]
                    if len(one):
                        key = np.unique(shingles(one, size))
                        bitmap = np.zeros(64 * WORDS, bool)
                        bitmap[(mix(key ^ GOLDEN) % np.uint64(64 * WORDS)).astype(np.int64)] = True
                        nodes.append(_node(one, None))
                        sizes.append(len(key))
                        bitmaps.append(np.packbits(bitmap).view(np.int64))
                        sets.append(key.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(bitmaps, pa.list_(pa.int64())), pa.array(sets, pa.list_(pa.int64()))], ["node", "size", "bits", "shingles"])

    return run


def _sketch(rows: DataFrame, prefix: str, *keep) -> DataFrame:
    """Size and bitmap of nodes, a column for each word of it."""
    return rows.select(*keep, F.col("size").alias(f"{prefix}size"), *(F.get("bits", F.lit(i)).alias(f"{prefix}{i}") for i in range(WORDS)))


def _within_reach(least: float) -> Column:
    """Whether the bitmaps u*, v* leave room for the shared shingles that the similarity takes."""
    only = lambda a, b: reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{a}{i}").bitwiseAND(F.bitwise_not(F.col(f"{b}{i}")))) for i in range(WORDS)))
    needed = (F.col("usize") + F.col("vsize")) * (least / (1 + least)) - 1e-6
    return (F.col("usize") - only("u", "v") >= needed) & (F.col("vsize") - only("v", "u") >= needed)


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs (u, v) whose shingle sets have that Jaccard similarity."""
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "u").join(right, "v").where(both >= least * (F.size("x") + F.size("y") - both)).select("u", "v")


def _near(small: DataFrame) -> DataFrame:
    """A stored table for a join: sent to the other side's rows if it is small, so that these need no exchange by a skewed key."""
    return F.broadcast(small) if small.count() <= MOST_SENT else small


def _open(active: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, node, root) of the buckets whose nodes are in several components."""
    labelled = active.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    several = labelled.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a != b").select("bucket")
    return labelled.join(_near(common.stored(several, "several")), "bucket")


def near_duplicates(docs: DataFrame, least: float = 0.8, bands: int = 24, rows: int = 6, size: int = 5) -> DataFrame:
    """doc_id, text_hash, class_id, n_class (rows in the class) and stays of every row of ``(doc_id, text)``.

    ``stays`` marks one document of each class (all of its rows, if rows repeat).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    signed = common.stored(docs.mapInArrow(_signer(bands, rows, size, least), "doc_id long, text_hash long, node binary, bands array<long>"), "signatures")
    least_row = F.min(F.struct(F.col("doc_id").isNull().alias("without_id"), "doc_id", "text_hash")).alias("row")
    nodes = common.stored(signed.groupBy("node").agg(least_row, F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands")), "nodes")
    # One exchange deals the buckets; their counts and their members both read it.
    placed = nodes.select(F.explode("bands").alias("bucket"), "node").repartition("bucket")
    shared = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("centre")).where("n > 1").select("bucket", "centre")
    members = common.stored(placed.join(shared, "bucket"), "buckets")

    place = lambda doc_id, text_hash: F.pmod(F.xxhash64(doc_id, text_hash), F.lit(FILTER_BITS)).alias("place")
    meeting = members.select("node").distinct().join(nodes.select("node", "row"), "node")
    wanted = docs.sparkSession.sparkContext.broadcast(_filter_of(meeting.select(place("row.doc_id", "row.text_hash"))))
    made = docs.select(place("doc_id", "text_hash"), "text").mapInArrow(_shingle_sets(size, wanted), "node binary, size int, bits array<long>, shingles array<long>")
    sets = common.stored(made.dropDuplicates(["node"]), "shingles")
    drawn = sets.select("node", "size", "bits")

    star = members.where("node != centre").select(F.col("centre").alias("u"), F.col("node").alias("v")).distinct()
    star = star.join(_sketch(drawn, "u", F.col("node").alias("u")), "u").join(_sketch(drawn, "v", F.col("node").alias("v")), "v").where(_within_reach(least)).select("u", "v")
    links = common.stored(_verified(star, sets, least), "links")
    active, centres = members.where("node != centre").select("bucket", "node"), 16
    roots = components.components(links)
    behind = [members]
    while True:
        active = common.stored(_open(active, roots), "open-buckets")
        common.forget(*behind)
        behind = [active]
        if active.isEmpty():
            break
        own = F.struct("node", "root")
        chosen = active.groupBy("bucket", F.pmod(F.xxhash64("node"), F.lit(centres)).alias("part")).agg(F.min_by(own, "node").alias("c")).select("bucket", F.col("c.node").alias("centre"), F.col("c.root").alias("centre_root"))
        chosen = common.stored(chosen.join(_sketch(drawn, "u", F.col("node").alias("centre")), "centre"), "centres")
        behind.append(chosen)
        pairs = active.join(_sketch(drawn, "v", "node"), "node").join(_near(chosen), "bucket").where((F.col("root") != F.col("centre_root")) & (F.col("node") != F.col("centre")) & _within_reach(least))
        pairs = pairs.select(F.least("node", "centre").alias("u"), F.greatest("node", "centre").alias("v")).distinct()
        found = common.stored(_verified(pairs, sets, least), "links")
        active = active.select("bucket", "node").join(chosen.select("bucket", F.col("centre").alias("node")), ["bucket", "node"], "left_anti")
        if not found.isEmpty():
            links, old = common.stored(links.union(found), "links"), links
            common.forget(old, roots)
            roots = components.components(links)
        common.forget(found)
        centres *= 4
    common.forget(*behind, links, sets)
    wanted.destroy()

    owned = nodes.select("node", "row", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = owned.groupBy("root").agg(F.min("row").alias("first"), F.sum("n").alias("n_class"))
    named = owned.select("node", "root").join(classes, "root").select("node", "first", "n_class")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    return signed.select("doc_id", "text_hash", "node").join(named, "node").select("doc_id", "text_hash", F.col("first.doc_id").alias("class_id"), "n_class", stays.alias("stays"))


def one_of_each(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, without near-duplicates: one row of each class."""
    found = near_duplicates(docs, **parameters).where("stays")
    kept = common.stored(found.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")), "kept")
    # The whole input row travels as one column, so its names meet no others.
    keyed = docs.select(common.whole_row(docs).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))
    out = keyed.join(kept, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash"))).select("row", "id", "hash", "n")
    if not kept.where("n > 1").isEmpty():  # rows that repeat doc_id and text
        once = out.where("n > 1").dropDuplicates(["id", "hash"])
        out = out.where("n = 1").unionByName(once)
    return out.select("row.*")
