"""Encode text columns with a public tokenizer, a batch at a time.

Runs inside Spark's Python tasks.  A text is cut where no token can span (before
a lone space or newline, and between a letter or digit and common punctuation),
the distinct chunks of the batch are found by Arrow's hash kernels, and only
chunks not met before go through the ``tokenizers`` library.  The ids are those
of encoding each whole text.
"""

from __future__ import annotations

import ctypes
import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CUT = "\x1f"
#: A text with this is encoded whole: white space before a space or newline, or the cut mark itself.
UNSAFE = r"[\s\x0b\x1c-\x1f\x{0085}\p{Z}][ \n]|\x1f"
LETTER_PUNCT = r"([\p{L}\p{N}])([.,;:!?|&$%#*])"
SAFE_PLACE = re.compile(r"(?<=\S)[ \n](?=\S)")


def _places(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of runs, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begins - (ends - sizes), sizes)


class ChunkEncoder:
    """Encoder with a bounded memory of chunks; one per Python worker."""

    def __init__(self, path: str, max_entries: int = 1_000_000, max_chars: int = 48):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        #: Chunk to its number; ids of chunk k are flat[begins[k] : begins[k + 1]].
        self.known: dict[str, int] = {}
        self.flat, self.begins = np.empty(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)
        self.max_entries, self.max_chars = max_entries, max_chars

    def whole(self, text: str) -> np.ndarray:
        """Ids of one text; very long texts are cut at safe places to bound memory."""
        parts, at = [], 0
        while len(text) - at > 65_536:
            place = SAFE_PLACE.search(text, at + 65_536)
            if not place:
                break
            parts.append(text[at : place.start()])
            at = place.start()
        parts.append(text[at:])
        ids = [self.tokenizer.encode_batch_fast([p], add_special_tokens=False)[0].ids for p in parts]
        return np.concatenate([np.asarray(x, np.uint32) for x in ids])

    def learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks in a row and their numbers.  Chunks that open with white space share one call each."""
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        joint = [i for i, c in enumerate(chunks) if c and c[0] in " \n" and not c[-1].isspace() and len(c) <= self.max_chars]
        alone = np.setdiff1d(np.arange(len(chunks)), joint).tolist()
        order, parts, sizes = [], [], []
        for k in range(0, len(alone), 2000):
            block = alone[k : k + 2000]
            if any(lengths[i] > 65_536 for i in block):
                own = [self.whole(chunks[i]) for i in block]
            else:
                own = [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([chunks[i] for i in block], add_special_tokens=False)]
            order += block
            parts += own
            sizes += [len(x) for x in own]
        for k in range(0, len(joint), 2000):
            block = joint[k : k + 2000]
            bounds = np.append(0, np.cumsum(lengths[block]))
            e = self.tokenizer.encode("".join(chunks[i] for i in block), add_special_tokens=False)
            first = np.array(e.offsets, np.int64).reshape(-1, 2)[:, 0]
            edges = np.searchsorted(np.searchsorted(bounds, first, "right") - 1, np.arange(len(block) + 1), "left")
            order += block
            parts.append(np.asarray(e.ids, np.uint32))
            sizes += np.diff(edges).tolist()
        flat = np.concatenate(parts) if parts else np.empty(0, np.uint32)
        size = np.array(sizes, np.int64)
        begin = np.cumsum(size) - size
        place = np.empty(len(chunks), np.int64)
        place[order] = np.arange(len(order))
        size, begin = size[place], begin[place]
        return flat[_places(begin, size)], size

    def keep(self, chunks: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        """Remember chunks, while there is room."""
        short = np.flatnonzero(np.fromiter(map(len, chunks), np.int64, len(chunks)) <= self.max_chars)[: self.max_entries - len(self.known)]
        if not len(short):
            return
        begin = np.cumsum(sizes) - sizes
        ids = flat[_places(begin[short], sizes[short])]
        n, used = len(self.known), int(self.begins[len(self.known)])
        while used + len(ids) > len(self.flat):
            self.flat = np.append(self.flat, np.empty(len(self.flat), np.uint32))
        while n + len(short) + 1 > len(self.begins):
            self.begins = np.append(self.begins, np.zeros(len(self.begins), np.int64))
        self.flat[used : used + len(ids)] = ids
        self.begins[n + 1 : n + 1 + len(short)] = used + np.cumsum(sizes[short])
        self.known.update(zip((chunks[i] for i in short.tolist()), range(n, n + len(short))))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row (nulls: empty), and where each text's ids begin."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        unsafe = pc.match_substring_regex(texts, UNSAFE).to_numpy(zero_copy_only=False)
        cut = pc.replace_substring(pc.replace_substring(texts, " ", CUT + " "), "\n", CUT + "\n")
        cut = pc.replace_substring_regex(cut, LETTER_PUNCT, r"\1" + CUT + r"\2")
        if unsafe.any():
            cut = pc.if_else(pa.array(unsafe), pa.scalar("", pa.large_string()), cut)
        lists = pc.split_pattern(cut, CUT)
        coded = lists.values.dictionary_encode()
        vocabulary = coded.dictionary.to_pylist()
        number = np.fromiter(map(self.known.get, vocabulary, repeat(-1)), np.int64, len(vocabulary))
        begins, sizes = self.begins[number], self.begins[number + 1] - self.begins[number]
        flat = self.flat[: int(self.begins[len(self.known)])]
        new = np.flatnonzero(number < 0)
        if len(new):
            fresh = [vocabulary[i] for i in new.tolist()]
            own, size = self.learn(fresh)
            sizes[new], begins[new] = size, len(flat) + np.cumsum(size) - size
            flat = np.concatenate([flat, own])
            self.keep(fresh, own, size)
        index = coded.indices.to_numpy()
        counts = sizes[index]
        ends = np.cumsum(counts)
        ids = flat[_places(begins[index], counts)]
        offsets = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        if unsafe.any():
            rows = np.flatnonzero(unsafe)
            own = [self.whole(texts[int(i)].as_py()) for i in rows]
            parts, at = [], 0
            grown = np.diff(offsets)
            for i, x in zip(rows, own):
                parts += [ids[at : offsets[i]], x]
                at = offsets[i + 1]
                grown[i] = len(x)
            ids = np.concatenate([*parts, ids[at:]])
            offsets = np.concatenate([[0], np.cumsum(grown)])
        return ids, offsets


try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim.argtypes = [ctypes.c_size_t]
except (OSError, AttributeError):  # another C library: its heap stays as it is
    _libc = None

_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str, max_entries: int = 1_000_000) -> ChunkEncoder:
    """The worker's encoder for a tokenizer file; kept between tasks."""
    if path not in _encoders or _encoders[path].max_entries != max_entries:
        _encoders[path] = ChunkEncoder(path, max_entries)
    return _encoders[path]


def retire() -> None:
    """Drop the worker's encoders: a task of another operator has no use for the chunks they know."""
    if _encoders:
        _encoders.clear()
        release()


def release() -> None:
    """Give freed memory back: workers stay between tasks, and their heaps count as used."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def slices(batch: pa.RecordBatch, column: int, max_bytes: int = 4_000_000):
    """Cut a batch so that each slice holds few bytes of text, whatever the lengths."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(sizes):
        total = np.cumsum(sizes[at : at + 8192])
        n = max(1, int(np.searchsorted(total, max_bytes, "right")))
        yield batch.slice(at, n)
        at += n
    release()
