import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tallyloom.llm import packing, queries, tokens, wavelet

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def tokenizer(name):
    t = Tokenizer.from_file(queries.tokenizer_file(name))
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), st.text(max_size=60), st.text(alphabet="ab .,\n\t\x1fé漢1<|>'", max_size=80)), max_size=6))
def test_ids_are_those_of_whole_texts(name, texts):
    encoder = tokens.ChunkEncoder(queries.tokenizer_file(name), max_entries=40)
    whole = tokenizer(name)
    for _ in range(2):
        ids, at = encoder.encode(pa.array(texts, pa.string()))
        for k, t in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == whole.encode(t or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70_000), min_size=1, max_size=400), st.integers(1, 64))
def test_wavelet_matrix(values, block):
    ids = np.array(values, np.uint32)
    head, blocks = wavelet.WaveletMatrix.build(ids, block=8 * block)
    m = wavelet.WaveletMatrix(head["n"], head["bits"], head["block"], head["zeros"], head["before"], head["spans"], memoryview(b"".join(blocks)))
    assert m.decode().tolist() == values
    for i in range(0, len(values), 7):
        assert m.access(i) == values[i]
    token = values[len(values) // 2]
    assert m.count(token) == values.count(token)
    assert m.count(token, 3, 50) == values[3:50].count(token)
    where = [i for i, v in enumerate(values) if v == token]
    assert [m.find(token, k) for k in range(len(where) + 1)] == [*where, -1]
    assert m.count(1 << 30) == 0 and m.find(1 << 30, 0) == -1


def test_files_round_trip(spark, odd_docs, no_docs, docs):
    path = queries.tokenizer_file("word_bpe_49k.json")
    whole = tokenizer("word_bpe_49k.json")
    for table in (odd_docs, docs):
        folder, manifest = wavelet.write_files(table, path, end_id=2, file_tokens=5000)
        got = wavelet.read_files(folder, manifest).collect()
        want = Counter((r["doc_id"], np.array([*whole.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for r in table.select("doc_id", "text").collect())
        assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == want
        at = 0
        for r in sorted(got, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["n_tokens"]
        ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
        assert ids == sorted(ids, key=lambda d: (d is not None, d))
    folder, manifest = wavelet.write_files(no_docs, path, end_id=2)
    assert wavelet.read_files(folder, manifest).count() == 0


def check_packed(table, rows, capacity=2048):
    whole = tokenizer("byte_bpe_50k.json")
    want = Counter((r["doc_id"], np.array([*whole.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for r in table.select("doc_id", "text").collect())
    total = sum(len(b) // 4 * n for (_, b), n in want.items())
    by_sequence, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["length"] == len(r["ids"]) // 4 and 0 < r["length"] <= capacity
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"], r["piece"], r["start"]].append(bytes(r["ids"]))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    assert sum(r["length"] for r in rows) == total
    short = {k: n for k, n in want.items() if len(k[1]) <= 4 * capacity}
    for (doc_id, ids), n in short.items():
        assert pieces[doc_id, 0, 0].count(ids) == n
    for r in rows:
        if r["piece"]:
            assert r["length"] == capacity
    return len(by_sequence), total


def test_packing(odd_docs, no_docs, docs):
    path = queries.tokenizer_file("byte_bpe_50k.json")
    for table in (odd_docs, docs):
        n, total = check_packed(table, packing.pack(table, path).collect())
        assert n <= -(-total // 2048) * 1.02 + 4
    assert packing.pack(no_docs, path).count() == 0


def test_fullest_bin_closes_first():
    p = packing.BestFit(10, 2)
    assert p.add("a", 6) is None and p.add("b", 5) is None
    assert p.add("c", 4) == ["a", "c"]  # the best fit is the fullest bin that takes it
    assert p.add("d", 7) is None
    assert p.add("e", 8) == ["d"]  # no place: the fuller of the two closes
    assert sorted(map(tuple, p.rest())) == [("b",), ("e",)]


def test_op1_and_op4_digests(spark, small, docs):
    whole, byte = tokenizer("word_bpe_49k.json"), tokenizer("byte_bpe_50k.json")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in queries.op4_tokens(spark, small).collect():
        ids = np.array([*whole.encode(text[r["doc_id"]], add_special_tokens=False).ids, 2], "<u4")
        assert r["n_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids.tobytes())
    for r in queries.op1_pack(spark, small).collect():
        ids = np.array([*byte.encode(text[r["doc_id"]], add_special_tokens=False).ids, 0], "<u4")[r["start"] :][: r["length"]]
        assert r["ids_crc32"] == zlib.crc32(ids.tobytes())
