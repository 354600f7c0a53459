"""WARC archives: writing with segments and revisits, and reassembly on reading.

A page becomes a response record (HTTP response, chunked transfer framing) or, if an earlier page
has the same payload, a revisit record. Blocks longer than a segment are cut: the first segment is
the response, the rest are continuation records that name the first record as their origin, with
segment numbers, the last one stating the total length. Archives are written by Spark's own
file writer, so that a lost executor leaves no half archive, and hold a bounded number of records
of bounded size, so that an archive can be read in one piece.

Reading walks an archive by the records' Content-Length, so payloads may contain anything. Only
segmented records are shuffled: they are grouped by origin, ordered by segment number, joined,
checked against the total length and then decoded.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cotejo.llm.common import cut, may_be_among, shared_dir, table

#: Bytes of a block in one record, records of one archive, bytes of one HTTP chunk.
SEGMENT, ARCHIVE_RECORDS, CHUNK = 32_768, 1_024, 8_192
#: Payloads below this many bytes are never revisits.
REVISIT_LEAST = 100
VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = re.compile(r"<urn:cotejo:page:(-?\d+|null)(?:#\S+)?>")


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record but for the last CRLF, which the file writer adds as its line separator."""
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"".join((VERSION, b"\r\n", head, b"\r\n", block, b"\r\n"))


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(piece), piece) for piece in (payload[k : k + size] for k in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """Undoes chunked transfer framing; ValueError where the framing is broken or cut short."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its length says")
        parts.append(body[at : at + size])
        at += size + 2


def page_records(name: str, url: str | None, payload: bytes, digest: str, first: str | None, size: int, segment: int, key: str) -> Iterator[bytes]:
    """The records of one page: a revisit if ``first`` names a page, else a response in segments."""
    fields = [("WARC-Record-ID", f"<urn:cotejo:page:{name}#{key}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~")))
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if first is not None:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
        yield _record([("WARC-Type", "revisit"), *fields, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:cotejo:page:{first}>"), ("Content-Type", "application/http; msgtype=response")], block)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    fields = [("WARC-Type", "response"), *fields, ("Content-Type", "application/http; msgtype=response")]
    if len(block) <= segment:
        yield _record(fields, block)
        return
    yield _record([*fields, ("WARC-Segment-Number", "1")], block[:segment])
    for number, at in enumerate(range(segment, len(block), segment), start=2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:cotejo:page:{name}#{key}-{number}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", f"<urn:cotejo:page:{name}#{key}>"), ("WARC-Segment-Number", str(number))]
        if at + segment >= len(block):
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        yield _record(more, block[at : at + segment])


def _revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, size, first: the page that has the same payload, for revisits.

    Only pages whose digest may be shared by several meet in a join, by a filter of fixed size;
    the others stay where they were read. A digest that very many pages have is split by adaptive
    execution, both sides being joined by sorting.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    shared = rows.where(F.col("size") >= REVISIT_LEAST).groupBy("digest").agg(F.min("page_id").alias("lowest"), F.count("*").alias("n")).where("n > 1 and lowest is not null").select("digest", "lowest")
    shared = cut(shared)
    may_be = may_be_among(shared.select(F.xxhash64("digest").alias("hash")))
    rows = rows.withColumn("shared", may_be(F.xxhash64("digest")))
    joined = rows.where("shared").join(shared.hint("merge"), "digest", "left")
    revisited = joined.withColumn("first", F.when(~F.col("page_id").eqNullSafe(F.col("lowest")), F.col("lowest"))).drop("lowest")
    return revisited.unionByName(rows.where("not shared").withColumn("first", F.lit(None).cast("long")))


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT, archive_records: int = ARCHIVE_RECORDS) -> None:
    """Writes ``pages`` (page_id, url, html) as WARC archives under ``path``, a shared folder.

    A null html is an empty payload, a null url leaves out the target. Of pages with equal payloads
    of at least REVISIT_LEAST bytes the one with the smallest page_id is the response; repeated
    rows of that page are responses as well. Null page_ids are revisits of a page with an id, else
    responses. An empty table writes no record.
    """

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            held: list[bytes] = []
            for page, url, payload, digest, size, first in batch[["page_id", "url", "payload", "digest", "size", "first"]].itertuples(index=False):
                seq += 1
                name, of = (None if pd.isna(x) else str(int(x)) for x in (page, first))
                held += page_records(name or "null", None if pd.isna(url) else url, payload, digest, of, int(size), segment, f"{task}-{seq}")
                if len(held) > 512:
                    yield pd.DataFrame({"record": held})
                    held = []
            yield pd.DataFrame({"record": held}, dtype=object)

    rows = _revisits(pages).select(F.col("page_id").cast("string").alias("page_id"), "url", F.when(F.col("first").isNull(), F.col("payload")).alias("payload"), "digest", "size", F.col("first").cast("string").alias("first"))
    records = rows.mapInPandas(build, "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.mode("overwrite").option("lineSep", "\r\n").option("maxRecordsPerFile", archive_records).text(path)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record; ValueError on a broken archive."""
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        lines = archive[at:end].split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}
        start = end + 4
        stop = start + int(fields["content-length"])
        if archive[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where its length says")
        yield fields, archive[start:stop]
        at = stop + 4


def _http(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    return fields, dechunked(body) if fields.get("transfer-encoding") == "chunked" else body


_ROW = "origin string, number int, total long, page_id long, url string, record_type string, refers_to long, digest string, size long, payload binary, block binary"


def _page_of(urn: str | None) -> int | None:
    found = _URN.fullmatch(urn or "")
    return int(found[1]) if found and found[1] != "null" else None


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in _ROW.split(", ")]
    kinds = {"number": "Int32", "total": "Int64", "page_id": "Int64", "refers_to": "Int64", "size": "Int64"}
    for batch in batches:
        for archive in batch["content"]:
            rows = []
            for fields, block in parse(bytes(archive)):
                kind = fields["warc-type"]
                digest = fields.get("warc-payload-digest", "").rpartition(":")[2] or None
                row = {"origin": fields.get("warc-segment-origin-id", fields["warc-record-id"]), "page_id": _page_of(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": kind, "digest": digest}
                if "warc-segment-number" in fields:
                    row |= {"number": int(fields["warc-segment-number"]), "block": block, "total": int(fields["warc-segment-total-length"]) if "warc-segment-total-length" in fields else None}
                elif kind == "revisit":
                    row |= {"refers_to": _page_of(fields["warc-refers-to"]), "size": int(_http(block)[0]["content-length"])}
                else:
                    payload = _http(block)[1]
                    row |= {"payload": payload, "size": len(payload)}
                rows.append(row)
                if len(rows) >= 1_000:
                    yield pd.DataFrame(rows, columns=names).astype(kinds)
                    rows = []
            yield pd.DataFrame(rows, columns=names).astype(kinds)


def reassemble(blocks: list[bytes], numbers: list[int], total: int | None) -> bytes:
    """The payload of a segmented response; ValueError if a segment or the total length is amiss."""
    order = sorted(range(len(blocks)), key=lambda k: numbers[k])
    if [numbers[k] for k in order] != list(range(1, len(blocks) + 1)):
        raise ValueError(f"segments are missing or repeated: {sorted(numbers)}")
    block = b"".join(blocks[k] for k in order)
    if total is None or len(block) != total:
        raise ValueError(f"{len(block)} bytes in segments, {total} stated")
    return _http(block)[1]


@F.pandas_udf(T.BinaryType())
def _joined(groups: pd.Series, totals: pd.Series) -> pd.Series:
    return pd.Series([reassemble([bytes(s["block"]) for s in group], [int(s["number"]) for s in group], None if pd.isna(total) else int(total)) for group, total in zip(groups, totals, strict=True)], dtype=object)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest of each page record.

    payload is null for revisits, whose length and digest come from their headers; those of
    responses are computed from the decoded payload, and a payload that does not have the digest
    its record states ends the query with an error. An empty folder of archives gives no rows.
    """
    archives = spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    records = archives.select("content").mapInPandas(_read, _ROW)
    whole = records.where("number is null").select("page_id", "url", "record_type", "refers_to", "payload", "size", "digest")
    segment = F.struct("number", "block")
    groups = records.where("number is not null").groupBy("origin").agg(
        F.collect_list(segment).alias("parts"), F.max("total").alias("total"),
        *[F.max(F.when(F.col("number") == 1, F.col(c))).alias(c) for c in ("page_id", "url", "record_type", "digest")],
    )
    joined = groups.select("page_id", "url", "record_type", F.lit(None).cast("long").alias("refers_to"), _joined("parts", "total").alias("payload"), F.lit(None).cast("long").alias("size"), "digest")
    every = whole.unionByName(joined)
    own = F.sha2("payload", 256)
    checked = F.when(F.col("payload").isNull() | (own == F.col("digest")), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("payload digest differs: page "), F.col("page_id").cast("string"))))
    return every.select("page_id", "url", "record_type", "refers_to", "payload", F.coalesce(F.octet_length("payload").cast("long"), "size").alias("payload_bytes"), checked.alias("payload_digest"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), d AS (
  SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p
), f AS (
  SELECT payload_digest, min(page_id) AS lowest FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN f.lowest IS NULL OR f.lowest IS NOT DISTINCT FROM d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.lowest IS NULL OR f.lowest IS NOT DISTINCT FROM d.page_id THEN NULL ELSE f.lowest END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND d.payload_bytes >= 100
"""
