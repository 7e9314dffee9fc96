"""WARC: archives of payloads in segments, and their reassembly.

Writing: each payload becomes one ``response`` record (an HTTP message in chunked transfer framing), cut into
continuation records where it is long, or a ``revisit`` record that refers to an equal payload.  Spark writes the
records as concatenated WARC files, gzip-compressed.

Reading: records are parsed from the files, segments grouped by their origin's identifier, ordered by number,
checked against the total length, joined, and freed from the chunked framing.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, ship, staged

#: Bytes of a segment's block at most, bytes of a transfer chunk, records of a file (64 MB at most, as it is read as a
#: whole), and the smallest payload that a revisit may stand for.
SEGMENT, CHUNK, FILE_RECORDS, LEAST_REVISIT = 1 << 16, 1 << 13, 1000, 100
_SPACE_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_VERSION = b"WARC/1.1\r\n"
RECORDS = "record_id string, kind string, page_id long, digest string, refers_to long, number int, origin string, total long, block binary"


def record_uri(key: object, number: int = 1) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE_ID, f'{key}/{number}')}>"


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    """A body in chunked transfer framing."""
    return b"".join(b"%x\r\n%s\r\n" % (len(x := body[i : i + size]), x) for i in range(0, len(body), size)) + b"0\r\n\r\n"


def dechunked(data: bytes) -> bytes:
    """Undoes the framing: chunk extensions and trailers are skipped, a truncated body is an error."""
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        size = int(data[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if len(data) < at + size + 2 or data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("truncated chunk")
        out.append(data[at : at + size])
        at += size + 2


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record but for the line end that separates it from the next."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return _VERSION + lines.encode() + b"\r\n" + block + b"\r\n"


def page_records(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, segment: int = SEGMENT, ordinal: int = 0) -> list[bytes]:
    """The records of one row: a revisit, or a response with its continuations.

    A row is named by its page, its payload's digest and its ordinal among the rows that are equal in both.
    """
    key = f"{page_id}/{digest}/{ordinal}"
    shared = [("WARC-Target-URI", re.sub(r"[\r\n]", "", url)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if page_id is not None:
        shared.append(("X-Page-Id", str(page_id)))
    if ordinal:
        shared.append(("X-Row-Ordinal", str(ordinal)))
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        return [record([("WARC-Type", "revisit"), ("WARC-Record-ID", record_uri(key)), *shared, ("WARC-Profile", profile), ("WARC-Refers-To", record_uri(f"{refers_to}/{digest}/0")), ("X-Refers-To-Page", str(refers_to))], b"")]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = []
    for n, part in enumerate(parts, 1):
        head = [("WARC-Type", "response" if n == 1 else "continuation"), ("WARC-Record-ID", record_uri(key, n)), *shared]
        if len(parts) > 1:
            head.append(("WARC-Segment-Number", str(n)))
        if n > 1:
            head.append(("WARC-Segment-Origin-ID", record_uri(key)))
        if 1 < n == len(parts):
            head.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(record(head, part))
    return out


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a file."""
    at = data.find(_VERSION)
    while 0 <= at < len(data):
        end = data.index(b"\r\n\r\n", at)
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:])}
        start, size = end + 4, int(headers["content-length"])
        if len(data) < start + size:
            raise ValueError("truncated record")
        yield headers, data[start : start + size]
        at = start + size
        while data[at : at + 2] == b"\r\n":
            at += 2


def first_copies(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(digest, first, most) of each payload that a row repeats.

    ``first`` is the smallest page_id of a payload of at least ``least`` bytes, ``most`` how many rows of one page_id
    have the payload.
    """
    keyed = pages.select(F.sha2("payload", 256).alias("digest"), "page_id", (F.octet_length("payload") >= least).alias("long"))
    same = keyed.groupBy("digest", "page_id", "long").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.when(F.col("long"), F.col("page_id"))).alias("first")
    return same.groupBy("digest").agg(first, F.max("n").alias("most"), F.sum("n").alias("n")).where("n > 1 and (first is not null or most > 1)").select("digest", "first", "most")


def write_archives(pages: DataFrame, path: str, least: int = LEAST_REVISIT, segment: int = SEGMENT, copies_bound: int = 200_000) -> None:
    """Writes (page_id, url, payload binary) as gzip-compressed WARC files under ``path``.

    Pages stay where they are read unless more than ``copies_bound`` payloads repeat (about 80 bytes each are
    broadcast below that); then they are joined by digest.  Rows that repeat a page_id and its payload get a number of
    their own, by partition and place in it, so that no task gathers them.
    """
    ship(pages.sparkSession)
    copies = staged(first_copies(pages, least), "copies")
    few = copies.limit(copies_bound + 1).count() <= copies_bound
    keyed = pages.withColumn("digest", F.sha2("payload", 256)).join(F.broadcast(copies) if few else copies, "digest", "left")
    refers = F.when(F.col("first") < F.col("page_id"), F.col("first"))
    again = F.coalesce(F.col("most") > 1, F.lit(False))
    keyed = keyed.withColumn("ordinal", F.when(again, F.monotonically_increasing_id() + 1).otherwise(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "payload"):
            rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to", "ordinal")), strict=True)
            out = [r for page, url, payload, digest, refers_to, ordinal in rows for r in page_records(page, url, payload, digest, refers_to, segment, ordinal)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    records = keyed.select("page_id", "url", "payload", "digest", refers.alias("refers_to"), "ordinal").mapInArrow(run, "record binary")
    # a string column only to the writer, which copies its bytes as they are; the line end closes each record
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under ``path``."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for data in batch.column("content"):
                rows, size = [], 0
                for h, block in parse(gzip.decompress(data.as_py())):
                    refers = h.get("x-refers-to-page")
                    rows.append((h["warc-record-id"], h["warc-type"], int(h["x-page-id"]) if "x-page-id" in h else None, h["warc-payload-digest"].partition(":")[2], int(refers) if refers else None, int(h.get("warc-segment-number", 0)), h.get("warc-segment-origin-id"), int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, block))
                    size += len(block)
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(run, RECORDS)


def body_of(message: bytes) -> bytes:
    """The payload of an HTTP message, freed from chunked framing."""
    head, _, body = message.partition(b"\r\n\r\n")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


RESULT = "page_id long, record_type string, refers_to long, payload binary, digest string, verified boolean"


def reassemble(records: DataFrame) -> DataFrame:
    """(page_id, record_type, refers_to, payload, digest, verified) of each response and revisit: continuations joined, framing undone.

    Segments must be numbered 1 to n without a gap and add up to the stated total, and the payload must have the
    stated digest; else ``verified`` is false and the payload null, as it is for revisits, which are verified.
    Segments are few; they are written once, so that the archives are parsed twice in all.
    """

    def checked(block: bytes, digest: str) -> tuple[bytes | None, bool]:
        try:
            payload = body_of(block)
        except ValueError:
            return None, False
        return (payload, True) if hashlib.sha256(payload).hexdigest() == digest else (None, False)

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "block"):
            kinds, digests = batch.column("kind"), batch.column("digest")
            done = [(None, True) if k == "revisit" else checked(b, d) for k, b, d in zip(kinds.to_pylist(), batch.column("block").to_pylist(), digests.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), kinds, batch.column("refers_to"), pa.array([p for p, _ in done], pa.binary()), digests, pa.array([ok for _, ok in done])], ["page_id", "record_type", "refers_to", "payload", "digest", "verified"])

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("number").sort_values("number")
        block, total = b"".join(group["block"]), group["total"].dropna()
        whole = list(group["number"]) == list(range(1, len(group) + 1)) and len(total) == 1 and int(total.iloc[0]) == len(block)
        payload, ok = checked(block, group["digest"].iloc[0]) if whole else (None, False)
        return pd.DataFrame({"page_id": [group["page_id"].iloc[0]], "record_type": ["response"], "refers_to": [None], "payload": [payload], "digest": [group["digest"].iloc[0]], "verified": [ok]})

    alone = records.where("number = 0 and kind in ('response', 'revisit')").mapInArrow(single, RESULT)
    parts = staged(records.where("kind in ('response', 'continuation') and number > 0").withColumn("origin", F.coalesce("origin", "record_id")), "segments")
    return alone.unionByName(parts.groupBy("origin").applyInPandas(joined, RESULT))


def archive_round_trip(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, record_type, refers_to, payload, digest, verified) of every page, as read back from the archives.

    A null html is an empty payload; a null url an empty one.  Every row has a record of its own, also where page_ids
    repeat or are null; rows with a null page_id are responses.  An empty table gives an empty result.  A revisit's
    payload is null: it is that of the response with its digest of the page it refers to.
    """
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    write_archives(pages, path)
    return reassemble(read_records(pages.sparkSession, path))
