"""Token-id files as wavelet matrices (operator 4).

A file holds the ids of consecutive documents as succinct bit planes, highest bit
first.  At each plane the ids keep their order among those with bit 0, then among
those with bit 1; ones counted before each block give rank, and rank and select on
the planes give access, counting and occurrence lookup without decoding the file.
Planes are cut into blocks of bits, each compressed by itself, so that one lookup
opens one block a plane.

Layout: ``TWM1``, the length of the header (unsigned 32 bit), the header (JSON),
then the payload: document ids, lengths and the blocks.

Documents are dealt by ranges of doc_id; each task encodes its range in order and
writes a file as soon as ``file_tokens`` ids are together, so memory does not grow
with the input.  A task that runs again writes files under a new attempt's name; only
the attempts in the returned manifest count.

Defined results: a null or empty text is one end id; null doc_ids come first; rows
that repeat a doc_id lie in the order of a hash of their text; other columns are not
read; an empty table gives no files.
"""

from __future__ import annotations

import json
import os
import posixpath
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tallyloom.llm import common, tokens

MAGIC = b"TWM1"
MANIFEST = "part int, attempt string, seq int, start long, n_tokens long, n_docs long"
DOCS = "doc_id long, start long, n_tokens long, ids binary"


class WaveletMatrix:
    """Bit planes with rank and select over one sequence of ids."""

    def __init__(self, n: int, bits: int, block: int, zeros: list[int], before: list[list[int]], spans: list[list[tuple[int, int]]], payload: memoryview):
        self.n, self.bits, self.block = n, bits, block
        self.zeros, self.before, self.spans, self.payload = zeros, before, spans, payload
        self._open: dict[tuple[int, int], np.ndarray] = {}

    @staticmethod
    def build(ids: np.ndarray, block: int = 1 << 16, level: int = 1) -> tuple[dict, list[bytes]]:
        """Header fields and compressed blocks."""
        import zstandard

        packer = zstandard.ZstdCompressor(level=level)
        bits = max(1, int(ids.max(initial=0)).bit_length())
        zeros, before, spans, out, at = [], [], [], [], 0
        row = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        for k in range(bits - 1, -1, -1):
            bit = (row & row.dtype.type(1 << k)) != 0
            ones, cells, count = [], [], 0
            for a in range(0, len(row), block):
                part = bit[a : a + block]
                ones.append(count)
                count += int(np.count_nonzero(part))
                data = packer.compress(np.packbits(part).tobytes())
                cells.append((at, len(data)))
                at += len(data)
                out.append(data)
            zeros.append(len(row) - count)
            before.append(ones)
            spans.append(cells)
            row = np.concatenate([row[~bit], row[bit]])
        return {"n": len(ids), "bits": bits, "block": block, "zeros": zeros, "before": before, "spans": spans}, out

    def _block(self, plane: int, b: int) -> np.ndarray:
        key = (plane, b)
        if key not in self._open:
            import zstandard

            if len(self._open) >= 64:
                self._open.clear()
            at, size = self.spans[plane][b]
            raw = zstandard.ZstdDecompressor().decompress(self.payload[at : at + size])
            self._open[key] = np.unpackbits(np.frombuffer(raw, np.uint8))[: min(self.block, self.n - b * self.block)]
        return self._open[key]

    def rank1(self, plane: int, i: int) -> int:
        """Ones of a plane before place i."""
        b, r = divmod(i, self.block)
        if b == len(self.before[plane]):
            return self.n - self.zeros[plane]
        return self.before[plane][b] + int(np.count_nonzero(self._block(plane, b)[:r]))

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of that kind."""
        marks = np.asarray(self.before[plane], np.int64)
        if not bit:
            marks = np.arange(len(marks)) * self.block - marks
        b = int(np.searchsorted(marks, k, "right")) - 1
        return b * self.block + int(np.flatnonzero(self._block(plane, b) == bit)[k - int(marks[b])])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for p in range(self.bits):
            bit = int(self._block(p, i // self.block)[i % self.block])
            ones = self.rank1(p, i)
            i = self.zeros[p] + ones if bit else i - ones
            token = token << 1 | bit
        return token

    def _down(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token >> self.bits:
            return 0, 0
        for p in range(self.bits):
            a, b = self.rank1(p, lo), self.rank1(p, hi)
            lo, hi = (self.zeros[p] + a, self.zeros[p] + b) if token >> (self.bits - 1 - p) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of a token in [lo, hi), as far as that lies in the sequence."""
        hi = self.n if hi is None else min(hi, self.n)
        a, b = self._down(token, min(max(lo, 0), hi), hi)
        return b - a

    def find(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence, or -1."""
        lo, hi = self._down(token, 0, self.n)
        if not 0 <= k < hi - lo:
            return -1
        i = lo + k
        for p in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - p) & 1
            i = self._select(p, bit, i - self.zeros[p] if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids, plane by plane from the lowest."""
        import zstandard

        reader = zstandard.ZstdDecompressor()
        row = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for p in range(self.bits - 1, -1, -1):
            raw = [np.frombuffer(reader.decompress(self.payload[at : at + size]), np.uint8) for at, size in self.spans[p]]
            bit = (np.concatenate([np.unpackbits(r)[: self.block] for r in raw]) if raw else np.empty(0, np.uint8))[: self.n] == 1
            up = np.empty_like(row)
            up[~bit] = row[: self.zeros[p]]
            up[bit] = row[self.zeros[p] :] | row.dtype.type(1 << (self.bits - 1 - p))
            row = up
        return row.astype(np.uint32)


def to_bytes(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    head, blocks = WaveletMatrix.build(ids)
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    sizes = np.asarray(lengths, "<i8").tobytes()
    head |= {"docs": len(doc_ids), "nulls": [i for i, d in enumerate(doc_ids) if d is None]}
    text = json.dumps(head, separators=(",", ":")).encode()
    return b"".join([MAGIC, struct.pack("<I", len(text)), text, keys, sizes, *blocks])


def from_bytes(data: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    """The matrix of a file, its document ids and their numbers of tokens."""
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    (size,) = struct.unpack_from("<I", data, 4)
    head = json.loads(data[8 : 8 + size])
    at, n = 8 + size, head["docs"]
    keys = np.frombuffer(data, "<i8", n, at).tolist()
    for i in head["nulls"]:
        keys[i] = None
    lengths = np.frombuffer(data, "<i8", n, at + 8 * n)
    matrix = WaveletMatrix(head["n"], head["bits"], head["block"], head["zeros"], head["before"], head["spans"], memoryview(data)[at + 16 * n :])
    return matrix, keys, lengths


def _writer(path: str, end_id: int, out: str, file_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(out)
        encode = tokens.encoder(path).encode
        part, attempt, seq, start, made = TaskContext.get().partitionId(), uuid.uuid4().hex, 0, 0, []
        held: list[np.ndarray] = []
        keys: list[int | None] = []
        sizes: list[np.ndarray] = []
        count = 0

        def write() -> None:
            nonlocal seq, start, count
            ids = np.concatenate(held)
            name = f"{part}-{attempt}-{start}-{seq:05d}.twm"
            with store.open_output_stream(posixpath.join(base, name)) as f:
                f.write(to_bytes(ids, keys, np.concatenate(sizes)))
            made.append((part, attempt, seq, start, len(ids), len(keys)))
            seq, start, count = seq + 1, start + len(ids), 0
            held.clear()
            keys.clear()
            sizes.clear()

        for whole in batches:
            for batch in tokens.slices(whole, 1):
                ids, at = encode(batch.column(1))
                lengths = np.diff(at) + 1
                own = np.full(int(lengths.sum()), end_id, np.uint32)
                own[np.arange(len(ids)) + np.repeat(np.arange(len(lengths)), lengths - 1)] = ids
                held.append(own)
                sizes.append(lengths)
                keys += batch.column(0).to_pylist()
                count += len(own)
                if count >= file_tokens:
                    write()
        if keys:
            write()
        kinds = (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*made)) or [()] * 6, kinds)], ["part", "attempt", "seq", "start", "n_tokens", "n_docs"])

    return run


def write_files(docs: DataFrame, tokenizer_path: str, end_id: int, file_tokens: int = 1 << 21) -> tuple[str, DataFrame]:
    """Encode ``(doc_id, text)`` into wavelet files in ascending doc_id order.

    Returns the folder and its manifest: a row per task that wrote (so at most one per
    shuffle partition), with the number of ids ahead of its files.
    """
    out = common.work_dir(docs.sparkSession, "tokens")
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(out if "://" in out or out.startswith("file:") else "file://" + os.path.abspath(out))
    store.create_dir(base, recursive=True)
    uri = out if ":" in out.split("/")[0] else "file://" + os.path.abspath(out)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(F.col("doc_id"))
    made = common.stored(
        rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).mapInArrow(_writer(tokenizer_path, end_id, uri, file_tokens), MANIFEST), "manifest"
    )
    parts = made.groupBy("part", "attempt").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_docs").alias("n_docs"))
    manifest = parts.withColumn("ahead", F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens"))
    return uri, manifest


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data, start in zip(batch.column(0), batch.column(1).to_pylist()):
            matrix, keys, lengths = from_bytes(data.as_py())
            ids = matrix.decode().astype("<u4")
            ends = np.cumsum(lengths)
            for a in range(0, len(keys), 2000):
                b = min(len(keys), a + 2000)
                lo = int(ends[a] - lengths[a])
                offsets = np.concatenate([[lo], ends[a:b]]) - lo
                values = ids[lo : int(ends[b - 1])].tobytes()
                binary = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer((offsets * 4).astype("<i8").tobytes()), pa.py_buffer(values)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(keys[a:b], pa.int64()), pa.array(start + ends[a:b] - lengths[a:b], pa.int64()), pa.array(lengths[a:b], pa.int64()), binary], ["doc_id", "start", "n_tokens", "ids"])


def read_files(folder: str, manifest: DataFrame) -> DataFrame:
    """Documents of the files in a manifest: doc_id, start, n_tokens and the ids' bytes."""
    spark = manifest.sparkSession
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.twm").load(folder).select("content", F.split(F.element_at(F.split("path", "/"), -1), "-").alias("name"))
    found = found.select("content", F.col("name")[0].cast("int").alias("part"), F.col("name")[1].alias("attempt"), F.col("name")[2].cast("long").alias("begin"))
    # One row per shuffle partition of the writing stage: bounded by its setting, not by the input.
    return found.join(F.broadcast(manifest.select("part", "attempt", "ahead")), ["part", "attempt"]).select("content", F.col("ahead") + F.col("begin")).mapInArrow(_reader, DOCS)
