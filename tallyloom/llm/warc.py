"""WARC archives of pages: written by Spark's text writer, read back by segment reassembly (operator 11).

Writing: every page is a ``response`` record, or a ``revisit`` where a row of smaller page_id
has the same payload; equality is that of length and SHA-256.  Only groups with copies are
kept from a narrow grouping, so the join that tells rows their group moves no page while
that table is small enough for Spark to broadcast (it reads its size from the stored
files) and is a sorted join with splittable hot groups beyond.  A response holds an HTTP
answer with chunked transfer framing; blocks longer than ``segment_bytes`` go into a first
record and ``continuation`` records.  A record ends in ``\\r\\n\\r\\n``, which is the line end
that the text writer is told to use, so files commit with Spark's own protocol: a task
that runs again leaves nothing behind.  A file has at most ``records_per_file`` records
of little over ``segment_bytes`` each; segments may lie in different files.

Reading: files are parsed one record at a time.  Segments are grouped by the identifier
of their origin, ordered by number and checked for gaps, repeats and the total length;
then chunked framing is decoded and the payload's digest compared.  A group is one
record, so it is no larger than the row that was written.  Plain and gzipped files (also
with a member for each record) are read.  A record that fails a check stays, with the
reason in ``error``.

Defined results: a null payload is an empty one; empty payloads are equal like others; rows
that repeat the least page_id of a group are all responses; a null page_id counts as the
largest; an empty table gives no records; only the named columns are read, whatever others
are called.  Control characters and spaces in a url are written as ``%XX``; a null url
has no header and comes back as null.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.llm import common, tokens

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
OK = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
RECORDS = "record_id string, record_type string, page_id long, url string, payload binary, payload_bytes long, payload_digest string, refers_to long, n_segments int, error string"
PARTS = "origin string, number int, total long, head string, block binary"


def digest(data: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(payload: bytes, chunk_bytes: int) -> bytes:
    """A payload in chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), chunk_bytes):
        piece = payload[at : at + chunk_bytes]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are passed over."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            raise ValueError("framing")
        n, at = int(size, 16), end + 2
        if not n:
            return b"".join(parts)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("framing")
        parts.append(body[at : at + n])
        at += n + 2


def _head(fields: list[tuple[str, object]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n").encode()


def _urn(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def _address(url: bytes | None) -> str | None:
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url.decode("utf-8", "replace"))


def records(name: str, page_id: int | None, url: str | None, payload: bytes, copy_of: tuple[int | None, str | None] | None, date: str, segment_bytes: int, chunk_bytes: int) -> list[bytes]:
    """The records of one page, each without its end; ``name`` is unique in the archive."""
    mark = digest(payload)
    about = [("WARC-Record-ID", _urn(name)), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{mark}"), ("X-Page-ID", page_id)]
    kind = ("Content-Type", "application/http; msgtype=response")
    if copy_of is not None:
        block = OK + b"Content-Length: %d\r\n\r\n" % len(payload)
        more = [("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", copy_of[1]), ("WARC-Refers-To-Date", date), ("X-Refers-To-Page-ID", copy_of[0])]
        return [_head([("WARC-Type", "revisit"), *about, *more, kind, ("Content-Length", len(block))]) + block]
    block = OK + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        return [_head([("WARC-Type", "response"), *about, kind, ("Content-Length", len(block))]) + block]
    out, starts = [], range(0, len(block), segment_bytes)
    for k, at in enumerate(starts, 1):
        piece = block[at : at + segment_bytes]
        number, size = ("WARC-Segment-Number", k), ("Content-Length", len(piece))
        if k == 1:
            out.append(_head([("WARC-Type", "response"), *about, number, kind, size]) + piece)
        else:
            total = len(block) if k == len(starts) else None
            own = [("WARC-Record-ID", _urn(f"{name}/{k}")), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Segment-Origin-ID", _urn(name))]
            out.append(_head([("WARC-Type", "continuation"), *own, number, ("WARC-Segment-Total-Length", total), size]) + piece)
    return out


def _writer(date: str, segment_bytes: int, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in tokens.slices(whole, 2):
                out = []
                for page_id, url, payload, is_copy, first, first_url in zip(*(c.to_pylist() for c in batch.columns)):
                    n += 1
                    copy_of = (first, _address(first_url)) if is_copy else None
                    out += records(f"page/{page_id}/{part}/{n}", page_id, _address(url), payload, copy_of, date, segment_bytes, chunk_bytes)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    return run


def write(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", date: str = "2024-01-01T00:00:00Z", segment_bytes: int = 1 << 14, chunk_bytes: int = 1 << 12, records_per_file: int = 5000) -> str:
    """Write the archive of ``pages`` to the shared folder; its path."""
    spark = pages.sparkSession
    name = lambda c: F.col(f"`{c.replace('`', '``')}`")
    rows = pages.select(name(page_id).cast("long").alias("page_id"), name(url).cast("string").cast("binary").alias("url"), F.coalesce(name(payload).cast("binary"), F.lit(b"")).alias("payload"))
    keyed = rows.select("*", F.sha2("payload", 256).alias("sha"), F.length("payload").alias("size"))
    groups = keyed.groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.min_by("url", "page_id").alias("first_url"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    copied = common.stored(groups.withColumn("grouped", F.lit(True)), "warc-groups")
    told = keyed.join(copied, ["sha", "size"], "left")
    is_copy = F.coalesce(F.col("grouped"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first"))
    lines = told.select("page_id", "url", "payload", is_copy.alias("is_copy"), "first", "first_url").mapInArrow(_writer(date, segment_bytes, chunk_bytes), "record binary")
    folder = common.work_dir(spark, "warc")
    # The bytes pass through unchanged: neither the cast nor the text writer looks at their encoding.
    lines.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(folder)
    common.forget(copied)
    return folder


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a file."""
    source = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := source.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head: dict[str, str] = {}
        last = ""
        while (line := source.readline()).strip():
            if line[:1] in b" \t" and last:
                head[last] += " " + line.decode("utf-8", "replace").strip()
                continue
            field, _, value = line.decode("utf-8", "replace").partition(":")
            last = field.strip().lower()
            head[last] = value.strip()
        yield head, source.read(int(head.get("content-length", 0)))


def _row(head: dict[str, str], block: bytes, n_segments: int, error: str | None, with_payload: bool) -> tuple:
    """One record as a row of :data:`RECORDS`."""
    number = lambda key: int(head[key]) if re.fullmatch(r"-?\d+", head.get(key, "")) else None
    kind, wanted = head.get("warc-type"), head.get("warc-payload-digest", "").partition(":")[2].upper() or None
    payload, size = None, None
    if error is None and len(block) != (number("content-length") if n_segments == 1 else len(block)):
        error = "length"
    if error is None:
        above, _, body = block.partition(END.encode())
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in above.split(b"\r\n")[1:])}
        if kind == "revisit":
            said = fields.get(b"content-length", b"")
            size = int(said) if said.isdigit() else None
        else:
            try:
                is_http = head.get("content-type", "").startswith("application/http")
                payload = block if not is_http else unchunked(body) if fields.get(b"transfer-encoding", b"").lower() == b"chunked" else body
                size, found = len(payload), digest(payload)
                if wanted not in (None, found):
                    error, payload = "digest", None
                wanted = wanted or found
            except ValueError as e:
                error = str(e)
    return head.get("warc-record-id"), kind, number("x-page-id"), head.get("warc-target-uri"), payload if with_payload else None, size, wanted, number("x-refers-to-page-id"), n_segments, error


KINDS = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string())
NAMES = ["record_id", "record_type", "page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to", "n_segments", "error"]


def _batches(rows: Iterator[tuple], kinds, names, weight: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Rows in batches of few bytes, as column ``weight`` counts them."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + len(row[weight] or b"")
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)


def _whole(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (r for batch in batches for data in batch.column(0) for r in parse(data.as_py()))
        rows = (_row(head, block, 1, None, with_payload) for head, block in found if head.get("warc-type") in ("response", "resource", "revisit") and "warc-segment-number" not in head)
        yield from _batches(rows, KINDS, NAMES, 4)

    return run


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import json

    def rows():
        for batch in batches:
            for data in batch.column(0):
                for head, block in parse(data.as_py()):
                    number = head.get("warc-segment-number", "")
                    if not number.isdigit():
                        continue
                    origin = head.get("warc-segment-origin-id") if head.get("warc-type") == "continuation" else head.get("warc-record-id")
                    total = head.get("warc-segment-total-length", "")
                    whole = len(block) == int(head.get("content-length", -1))
                    yield origin, int(number), int(total) if total.isdigit() else None, json.dumps(head) if number == "1" or not whole else None, block

    yield from _batches(rows(), (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary()), ["origin", "number", "total", "head", "block"], 4)


def reassemble(origin: str | None, parts: list[dict]) -> tuple[dict[str, str], bytes, str | None]:
    """Headers, block and what is wrong with one record's segments, which come in the order of their numbers."""
    import json

    head = json.loads(parts[0]["head"]) if parts[0]["number"] == 1 and parts[0]["head"] else {"warc-record-id": origin}
    block = b"".join(p["block"] for p in parts)
    if [p["number"] for p in parts] != list(range(1, len(parts) + 1)) or parts[-1]["total"] is None:
        return head, block, "segments"
    cut = any(p["head"] for p in parts[1:]) or len(parts[0]["block"]) != int(head.get("content-length", -1))
    return head, block, "length" if cut or len(block) != parts[-1]["total"] else None


def _joined(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for k in range(batch.num_rows):
                    parts = batch.column(1)[k].as_py()
                    head, block, error = reassemble(batch.column(0)[k].as_py(), parts)
                    yield _row(head, block, len(parts), error, with_payload)

        yield from _batches(rows(), KINDS, NAMES, 4)

    return run


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Records of the archives below ``folder``: responses, resources and revisits, whole or reassembled.

    ``payloads`` false leaves the bytes out (null); their number and digest are those of the
    decoded payload either way.  A revisit has the digest and length that its headers state;
    :func:`resolve` holds them against the response.
    """
    files = spark.read.format("binaryFile").load(folder).select("content")
    parts = files.mapInArrow(_parts, PARTS).groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("number", "total", "head", "block"))).alias("parts"))
    return files.mapInArrow(_whole(payloads), RECORDS).unionByName(parts.mapInArrow(_joined(payloads), RECORDS))


def resolve(found: DataFrame) -> DataFrame:
    """Records with ``payload_bytes`` of revisits taken from the response that they refer to.

    A revisit without a response of its page and digest gets the error ``dangling``.
    """
    sources = found.where("record_type != 'revisit' AND error IS NULL").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("there"))
    revisits = found.where("record_type = 'revisit'").join(sources, ["refers_to", "payload_digest"], "left")
    revisits = revisits.withColumn("error", F.coalesce("error", F.when(F.col("there").isNull(), F.lit("dangling")))).withColumn("payload_bytes", F.coalesce("there", "payload_bytes"))
    return found.where("record_type IS NULL OR record_type != 'revisit'").unionByName(revisits.select(*found.columns))
