"""WARC round trips, broken segments and the registered query against plain Python."""

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import types as T

from tallyloom.llm import common, queries, warc

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())] + [T.StructField(n, T.StringType()) for n in ("sha", "size", "first", "record", "a.b", "we`ird")])
LONG = "<p>" + "Ünïcode 漢字 🙂 \r\n\r\nWARC/1.1\r\n" * 4000 + "</p>"


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def told(pages):
    """(page_id, bytes, digest, type, refers_to) of every page."""
    raw = [(p, (h or "").encode()) for p, h in pages]
    out = []
    for page_id, data in raw:
        ids = [p for p, d in raw if d == data and p is not None]
        first = min(ids, default=None)
        out.append((page_id, len(data), b32(data), *(("response", None) if page_id == first else ("revisit", first))))
    return sorted(out, key=repr)


def rows(found):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found.collect()), key=repr)


@pytest.fixture(scope="module")
def odd_pages():
    texts = [None, "", "a", LONG, "a", LONG, "x" * 16_384, "\r\n\r\n", "0\r\n\r\n", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc"]
    return [(i, f"http://h/{i} x\n", t) for i, t in enumerate(texts)] + [(None, None, "alone"), (None, "u", "a"), (4, "again", "a"), (2, "again", "a")]


def test_round_trip(spark, odd_pages):
    df = spark.createDataFrame([(*r, *["c"] * 6) for r in odd_pages], PAGES).repartition(3)
    found = warc.resolve(warc.read(spark, warc.write(df, segment_bytes=1000, chunk_bytes=77, records_per_file=3)))
    got = found.collect()
    assert rows(found) == told([(p, h) for p, _, h in odd_pages])
    assert not [r for r in got if r["error"]]
    by_page = {p: h for p, _, h in odd_pages if p is not None}
    for r in got:
        if r["record_type"] == "response" and r["page_id"] is not None:
            assert bytes(r["payload"]).decode() == (by_page[r["page_id"]] or "")
    assert len({r["record_id"] for r in got}) == len(odd_pages)
    assert {r["url"] for r in got if r["page_id"] == 3} == {"http://h/3%20x%0A"}
    assert max(r["n_segments"] for r in got) > 100


def test_groups_joined_by_sort(spark, odd_pages):
    df = spark.createDataFrame([(*r, *["c"] * 6) for r in odd_pages], PAGES)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows(warc.read(spark, warc.write(df), payloads=False)) == told([(p, h) for p, _, h in odd_pages])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_empty_table(spark):
    assert warc.resolve(warc.read(spark, warc.write(spark.createDataFrame([], PAGES)))).count() == 0


def archive(spark, files):
    """Files of whole archives, written without the operator's writer."""
    folder = common.work_dir(spark, "foreign")
    place = folder.removeprefix("file:").replace("//", "/")
    import os

    os.makedirs(place)
    for k, data in enumerate(files):
        with open(f"{place}/{k}.warc", "wb") as f:
            f.write(data)
    return folder


def test_segments_in_any_order_and_file(spark):
    made = warc.records("one", 7, "http://u", b"abc" * 5000, None, "d", 512, 100)
    assert len(made) > 20
    made = [r + b"\r\n\r\n" for r in made]
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    other = [r + b"\r\n\r\n" for r in warc.records("two", 8, None, b"", None, "d", 512, 100)]
    files = [info + b"".join(made[::-2]), b"".join(gzip.compress(r) for r in [*made[-2::-2], *other])]
    got = {r["page_id"]: r for r in warc.read(spark, archive(spark, files)).collect()}
    assert set(got) == {7, 8}
    assert bytes(got[7]["payload"]) == b"abc" * 5000 and got[7]["error"] is None and got[7]["n_segments"] == len(made)
    assert bytes(got[8]["payload"]) == b"" and got[8]["error"] is None and got[8]["url"] is None


@pytest.mark.parametrize(
    ("fault", "error"),
    [
        (lambda r: r[:3] + r[4:], "segments"),
        (lambda r: r[:-1], "segments"),
        (lambda r: [*r, r[2]], "segments"),
        (lambda r: r[1:], "segments"),
        (lambda r: [*r[:-1], r[-1].replace(b"Total-Length: ", b"Total-Length: 9")], "length"),
        (lambda r: [r[0].replace(b"64\r\n", b"6z\r\n"), *r[1:]], "framing"),
        (lambda r: [r[0].replace(b"abcabc", b"abcxyz", 1), *r[1:]], "digest"),
    ],
)
def test_broken_segments(spark, fault, error):
    made = fault(warc.records("one", 7, "http://u", b"abc" * 5000, None, "d", 512, 100))
    sound = warc.records("two", 8, "http://v", b"fine", None, "d", 512, 100)
    got = warc.read(spark, archive(spark, [b"".join(r + b"\r\n\r\n" for r in [*made, *sound])])).collect()
    assert len(got) == 2
    for r in got:
        assert (r["error"], r["payload"] is None) == ((None, False) if r["page_id"] == 8 else (error, True))


def test_cut_file_and_dangling_revisit(spark):
    whole = warc.records("one", 7, "http://u", b"abc" * 50, None, "d", 1 << 20, 100)[0]
    copy = warc.records("two", 9, "http://u", b"zzz", (8, "http://v"), "d", 1 << 20, 100)[0]
    got = {r["page_id"]: r["error"] for r in warc.resolve(warc.read(spark, archive(spark, [copy + b"\r\n\r\n" + whole[:-20]]))).collect()}
    assert got == {7: "length", 9: "dangling"}


def test_query(spark, small):
    pages = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    found = queries.op11_warc(spark, small)
    assert rows(found) == told(pages)
    assert found.where("error IS NOT NULL").count() == 0
