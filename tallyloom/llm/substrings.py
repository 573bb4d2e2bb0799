"""Exact removal of repeated substrings by sharded suffix arrays (operator 10).

A byte goes if a string of ``width`` bytes over it also starts anywhere else.  All texts
in one suffix array would be one task's work, so windows that may be equal are brought
together first:

1. every window of ``width`` bytes has an anchor, its ``gram``-byte string of least hash
   (the leftmost of equal ones).  Neighbouring windows with one anchor form a fragment.
   Equal windows have equal anchors at equal places, so they lie in fragments of one
   anchor; an anchor that occurs once settles its windows without reading them again;
2. fragments that occur twice as they are (equal anchor, and equal in a 96-bit digest) are
   repeated as a whole, and one of them stands for all from there on;
3. one of each kind of fragment of a repeated anchor is cut from its text and dealt to
   shards by anchor.  A shard is sorted by induced sorting, and permuted common prefixes
   of ``width`` or more mark its repeated windows (:mod:`sais`);
4. an anchor whose fragments are more than a shard may hold is split before: windows with
   half or more of the other bytes left of the anchor go by the anchor and those bytes,
   the others by it and as many bytes on its right.  That leaves equal windows together,
   parts fragments that differ near the anchor, and doubles what is known of a window; so
   after at most eight rounds all groups fit or are windows of one string.

Counts and joins run over narrow rows (a few numbers for about ninety bytes of text);
copies of a text share one key, and marks are made distinct before they are gathered by
text, so a gathered list is never longer than its text.  Keys with a large share of all
rows are never dealt to one task: they are few, so they go to the rows (``_meet``).

Defined results: a null text is empty; texts shorter than ``width`` stay whole; equal
texts of ``width`` bytes or more go wholly; very long texts are scanned in pieces whose
windows overlap; rows that repeat a doc_id are documents of their own; other columns
are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tallyloom.llm import common, sais, tokens
from tallyloom.llm.minhash import GOLDEN, M1, mix

PLACE = 24
#: Bytes hashed at once, and of one piece of a longer text.
SLICE, PIECE = 1 << 20, 1 << 23
FRAGMENTS = "k1 long, k2 int, start long, n int, anchor long, frag long, more int"
KIND = ["anchor", "frag", "more"]
RANGES = "k1 long, k2 int, lo long, hi long"


def gram_hashes(data: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``width`` bytes from each place, put together from hashes of 1, 2, 4 ... bytes."""
    with np.errstate(over="ignore"):
        power = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN + np.uint64(seed))[data]
        out, have, size = None, 0, 1
        while True:
            if width & size:
                if out is None:
                    out = power
                else:
                    n = len(power) - have
                    out = _two(out[:n], power[have : have + n])
                have += size
            if have == width:
                return out[: max(0, len(data) - width + 1)]
            power = _two(power[:-size], power[size:]) if len(power) > size else power[:0]
            size *= 2
            if not len(power):
                return power


def _two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(32))) * M1 + b
    x ^= x >> np.uint64(29)
    return x * GOLDEN


def least_places(hashes: np.ndarray, span: int) -> np.ndarray:
    """Place of the least of ``span`` hashes from each place, the leftmost of equal ones."""
    key = (hashes >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while size * 2 <= span:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < span:
        key = np.minimum(key[: len(key) - (span - size)], key[span - size :])
    return (key & np.uint64((1 << PLACE) - 1)).astype(np.int64)


def fragments(data: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(first window, windows, hash of the anchor) of all fragments of the texts in a row."""
    if len(data) < width:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    hashes = gram_hashes(data, gram)
    least = least_places(hashes, width - gram + 1)
    last = offsets[1:] - width
    held = last >= offsets[:-1]
    edge = np.zeros(len(least) + 1, np.int64)
    np.add.at(edge, offsets[:-1][held], 1)
    np.add.at(edge, last[held] + 1, -1)
    valid = np.flatnonzero(np.cumsum(edge)[:-1])
    if not len(valid):
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    own = least[valid]
    first = np.flatnonzero(np.append(True, (np.diff(own) != 0) | (np.diff(valid) != 1)))
    n = np.diff(np.append(first, len(valid)))
    return valid[first], n, hashes[own[first]]


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _digests(parts) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of a 128-bit hash of each."""
    import xxhash

    whole = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), ">u8").reshape(-1, 2)
    return whole[:, 1].astype(np.uint64).view(np.int64), (whole[:, 0] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def _scan(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tokens.slices(whole, 2, SLICE):
                data, offsets = _bytes_of(batch.column(2))
                k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                # Only a slice of one very long text has several pieces.
                for a in range(0, max(1, len(data)), PIECE):
                    piece = data[a : a + PIECE + width - 1]
                    bounds = offsets if len(data) <= PIECE else np.array([0, len(piece)])
                    first, n, anchor = fragments(piece, bounds, width, gram)
                    row = np.searchsorted(bounds, first, "right") - 1
                    view = memoryview(piece)
                    frag, more = _digests(view[x : x + m + width - 1] for x, m in zip(first.tolist(), n.tolist()))
                    columns = [pa.array(k1[row]), pa.array(k2[row]), pa.array(first - bounds[row] + a), pa.array(n.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(frag), pa.array(more)]
                    yield pa.RecordBatch.from_arrays(columns, ["k1", "k2", "start", "n", *KIND])

    return run


CUT = FRAGMENTS + ", copies int, data binary, left int, size int"
CUT_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32()]
CUT_NAMES = ["k1", "k2", "start", "n", *KIND, "copies", "data", "left", "size"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * len(CUT_NAMES), CUT_KINDS)], CUT_NAMES)


def _cut(width: int, gram: int):
    """Wanted fragments of each text with their bytes and where (``left``) the anchor of ``size`` bytes begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tokens.slices(whole, 2):
                rows = []
                for k1, k2, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                    raw = (text or "").encode()
                    for w in wanted:
                        # The anchor lies in all windows, so it begins at the last one's begin or later.
                        rows.append((k1, k2, w["start"], w["n"], w["anchor"], w["frag"], w["more"], w["copies"], raw[w["start"] : w["start"] + w["n"] + width - 1], -1, gram))
                        if len(rows) >= 20_000:
                            yield _batch(rows)
                            rows.clear()
                yield _batch(rows)

    return run


def _split(width: int):
    """Each fragment as up to two, whose anchors hold half or more of the bytes of a window that the old one lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                rows, new = [], []
                for row in zip(*(c.to_pylist() for c in batch.slice(at, 2000).columns)):
                    k1, k2, start, n, anchor, _, _, copies, data, left, size = row
                    if left < 0:
                        own = gram_hashes(np.frombuffer(data, np.uint8), size).view(np.int64)
                        left = n - 1 + int(np.flatnonzero(own[n - 1 :] == anchor)[0])
                    half = (width - size + 1) // 2
                    cut = min(n, max(0, left - half + 1))
                    for first, stop, begin, long in ((0, cut, left - half, size + half), (cut, n, left, width - half + 1)):
                        if stop > first:
                            key = xxhash.xxh3_64_intdigest(data[begin : begin + long], seed=2 * size + (first > 0 or begin == left))
                            rows.append((k1, k2, start + first, stop - first, key, copies, data[first : stop + width - 1], begin - first, long))
                frag, more = _digests(r[6] for r in rows) if rows else (np.empty(0, np.int64), np.empty(0, np.int32))
                keys = np.array([r[4] for r in rows], np.uint64).view(np.int64).tolist()
                new = [(*r[:4], k, f, m, *r[5:]) for r, k, f, m in zip(rows, keys, frag.tolist(), more.tolist())]
                yield _batch(new)

    return run


def _runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


def _sorted_shard(width: int):
    """Repeated windows of a shard's fragments that occur once, as ranges of windows."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(KIND).sort_values(KIND, ignore_index=True)
        sizes = rows["data"].str.len().to_numpy() + 1
        begins = np.cumsum(sizes) - sizes
        # 0 ends the text and 1 the fragments; bytes are 2 and more.
        text = np.ones(int(sizes.sum()) + 1, np.int64)
        inner = np.ones(len(text), bool)
        inner[np.append(begins + sizes - 1, len(text) - 1)] = False
        text[inner] = np.frombuffer(b"".join(rows["data"]), np.uint8).astype(np.int64) + 2
        text[-1] = 0
        again = sais.repeated_windows(text, width)
        out: list[tuple] = []
        for k1, k2, start, n, at, copies in zip(rows["k1"], rows["k2"], rows["start"], rows["n"], begins, rows["copies"]):
            if copies == 1:
                for lo, hi in zip(*_runs(again[at : at + n])):
                    out.append((k1, k2, start + lo, start + hi))
        return pd.DataFrame(out, columns=["k1", "k2", "lo", "hi"]).astype({"k1": "int64", "k2": "int32", "lo": "int64", "hi": "int64"})

    return run


def _remove(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for whole in batches:
            for batch in tokens.slices(whole, 1):
                sizes, spans, kept = [], [], []
                for text, ranges in zip(batch.column(1), batch.column(2)):
                    raw = (text.as_py() or "").encode()
                    own: list[list[int]] = []
                    for r in sorted(ranges.as_py() or [], key=lambda r: r["lo"]):
                        start, stop = r["lo"], r["hi"] + width - 1
                        if own and start <= own[-1][1]:
                            own[-1][1] = max(own[-1][1], stop)
                        else:
                            own.append([start, stop])
                    ends = [0, *(x for s in own for x in s), len(raw)]
                    sizes.append(len(raw))
                    spans.append([{"start": a, "stop": b} for a, b in own])
                    kept.append(b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2])))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return run


def _meet(rows: DataFrame, keys: DataFrame, on: list[str], total: int) -> DataFrame:
    """``rows`` with those columns of ``keys`` (one row a key, with its number of rows ``m``).

    A key with more than a 20,000th of all rows would make one task long; there are fewer
    than 20,000 such keys, so these go to the rows and the others by an exchange.
    """
    keys = keys.where("m > 1")
    hot = F.col("m") > max(20_000, total // 20_000)
    few = F.broadcast(keys.where(hot))
    own = rows.join(few, on).select(*rows.columns, *(c for c in keys.columns if c not in on))
    rest = rows.join(few.select(*on), on, "left_anti").join(keys.where(~hot), on)
    return own.unionByName(rest.select(*own.columns))


def _ranges(rows: DataFrame) -> DataFrame:
    return rows.select("k1", "k2", F.col("start").alias("lo"), (F.col("start") + F.col("n")).alias("hi"))


def _split_large(large: DataFrame, width: int, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """Groups within ``most`` bytes from fragments of larger ones, and the ranges that are settled on the way."""
    small, marks = None, []
    while not large.isEmpty():
        parts = common.stored(large.mapInArrow(_split(width), CUT), "split")
        total = parts.count()
        kinds = parts.groupBy(*KIND).agg(F.sum("copies").alias("m"), F.min(F.struct("k1", "k2", "start")).alias("one"))
        kinds = common.stored(kinds, "split-kinds")
        marks.append(_ranges(_meet(parts.where("copies = 1"), kinds.select(*KIND, "m"), KIND, total)))
        open_ = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("m").alias("least"), F.sum("m").alias("m")).where("kinds > 1 AND least = 1").select("anchor", "m")
        each = _meet(parts, open_, ["anchor"], total).drop("m").join(kinds.select(*KIND, "one", F.col("m").alias("all")), KIND)
        one = each.where("k1 = one.k1 AND k2 = one.k2 AND start = one.start").withColumn("copies", F.least("all", F.lit(2)).cast("int")).select(*CUT_NAMES)
        one = common.stored(one, "split-ones")
        sizes = one.groupBy("anchor").agg(F.sum(F.octet_length("data")).alias("bytes"), F.count(F.lit(1)).alias("m"))
        over = common.stored(sizes.where(F.col("bytes") > most).select("anchor", "m"), "split-large")
        fits = one.join(over, "anchor", "left_anti")
        small = fits if small is None else small.unionByName(fits)
        large = _meet(one, over, ["anchor"], one.count()).select(*CUT_NAMES)
    return small, marks


def repeated_windows(keyed: DataFrame, width: int, gram: int, shard_bytes: int) -> DataFrame:
    """Ranges (k1, k2, lo, hi) of window starts whose window occurs elsewhere; ``keyed`` has k1, k2, doc_id, text."""
    found = common.stored(keyed.where(F.octet_length("text") >= width).select("k1", "k2", "text").mapInArrow(_scan(width, gram), FRAGMENTS), "fragments")
    total = found.count()
    anchors = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"), (F.min("frag") != F.max("frag")).alias("several"), (F.min("more") != F.max("more")).alias("too")).where("m > 1").select("anchor", "m", F.expr("several OR too").alias("several"))
    again = common.stored(_meet(found, common.stored(anchors, "anchors"), ["anchor"], total).drop("m"), "repeated")
    common.forget(found)

    kinds = again.where("several").groupBy(*KIND).agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("k1", "k2", "start", "n")).alias("one"))
    kinds = common.stored(kinds.select(*KIND, "m", "one.*"), "kinds")
    marks = [_ranges(again.where("not several")), _ranges(_meet(again.where("several"), kinds.select(*KIND, "m"), KIND, total))]

    # Fragments that must be read: all kinds of an anchor with one that occurs once.
    mixed = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"), F.min("m").alias("least")).where("least = 1").select("anchor", "m")
    fragment = F.struct("start", "n", *KIND, F.least("m", F.lit(2)).cast("int").alias("copies"))
    wanted = kinds.join(mixed.select("anchor"), "anchor", "left_semi").groupBy("k1", "k2").agg(F.collect_list(fragment).alias("wanted"))
    one_copy = keyed.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"))
    wanted = wanted.join(one_copy, ["k1", "k2"]).withColumnsRenamed({"k1": "w1", "k2": "w2", "doc_id": "w_id"})
    same = (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2")) & F.col("doc_id").eqNullSafe(F.col("w_id"))
    texts = keyed.join(wanted, same).select("k1", "k2", "text", "wanted")
    cut = common.stored(texts.mapInArrow(_cut(width, gram), CUT), "cut")

    most = 4 * shard_bytes
    over = cut.groupBy("anchor").agg(F.sum(F.octet_length("data")).alias("bytes"), F.count(F.lit(1)).alias("m")).where(F.col("bytes") > most).select("anchor", "m")
    over = common.stored(over, "large")
    dealt = cut.join(over, "anchor", "left_anti")
    if not over.isEmpty():
        small, settled = _split_large(_meet(cut, over, ["anchor"], cut.count()).dropDuplicates(["k1", "k2", "start"]).select(*CUT_NAMES), width, most)
        dealt, marks = dealt.unionByName(small), marks + settled
    held = dealt.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    shards = max(1, -(-held // shard_bytes))
    marks.append(dealt.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).groupBy("shard").applyInPandas(_sorted_shard(width), RANGES))
    return reduce(DataFrame.unionByName, marks)


def deduplicate(docs: DataFrame, width: int = 200, gram: int = 64, shard_bytes: int = 1 << 19) -> DataFrame:
    """doc_id, n_bytes, removed ``spans`` (bytes) and the ``kept`` bytes of every row of ``(doc_id, text)``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.select(F.xxhash64("text").alias("k1"), F.hash("text").alias("k2"), "doc_id", "text")
    marks = repeated_windows(keyed, width, gram, shard_bytes).distinct()
    lists = marks.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    joined = keyed.join(lists, ["k1", "k2"], "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(_remove(width), "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")
