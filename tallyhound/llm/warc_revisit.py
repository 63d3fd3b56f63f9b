"""WARC not-modified revisits: each is resolved to the latest earlier full response of its canonical URL.

The as-of join is one ordered pass: captures are range-partitioned by time, and inside (URL, range) a window
carries the last response. A range's last response per URL, one small row, is carried to later ranges by a
second window. So even a URL that holds a third of all captures is dealt over all ranges; payloads stay where
they are, only their digests move.

A revisit is ``resolved`` if its validators agree with the response found: the entity tags where both have
one (compared weakly), else the last-modified dates where both have one, else the payload digests where both
have one; without a common validator it is ``unchecked``. Otherwise it is ``mismatch``, or ``orphan`` if there
is no earlier response. Of its headers, only those permitted in a 304 replace the response's.

Cases: a null URL has no canonical form and joins nothing; captures with a null time come first; equal
times are ordered by id, null ids first, then responses before revisits; header names are compared in lower case; repeated rows are resolved
each; a null body has a null digest; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhound.llm.staging import stage

#: The fields that a 304 response may update (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that do not name another page.
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|ref|sessionid)=|^$"
RECORDS = "file string, offset long, type string, uri string, date string, record_id string, profile string, status int, headers map<string,string>, payload binary"


def canonical_url(url: Column) -> Column:
    """host/path?parameters: no scheme, user, www, default port, fragment, tracking or trailing slash; sorted parameters."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r":(80|443)$", ""), r"^www[0-9]*\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    params = F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda x: ~x.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""))


def resolve_revisits(captures: DataFrame, range_rows: int = 100_000) -> DataFrame:
    """captures: id, url, ts, is_revisit, etag, modified, digest, headers (map, lower-case names).

    Adds canonical_url, status, resolved_id, resolved_digest and merged_headers. A response resolves to itself."""
    own = captures.select("id", canonical_url(F.col("url")).alias("canonical_url"), "ts", F.coalesce("is_revisit", F.lit(False)).alias("is_revisit"), "etag", "modified", "digest", "headers")
    ranges = max(1, -(-own.count() // range_rows))
    own = stage(own.repartitionByRange(ranges, "ts", "id", "is_revisit").withColumn("range", F.spark_partition_id()), "captures")

    full = F.when(~F.col("is_revisit"), F.struct("ts", "id", "etag", "modified", "digest", "headers"))
    before = Window.orderBy("ts", "id", "is_revisit").rowsBetween(Window.unboundedPreceding, -1)
    here = own.withColumn("near", F.last(full, ignorenulls=True).over(before.partitionBy("canonical_url", "range")))
    # one row a URL and range, its last response or null
    response = F.when(~F.col("is_revisit"), F.struct("ts", "id"))
    spans = own.filter(F.col("canonical_url").isNotNull()).groupBy("canonical_url", "range").agg(F.max_by(F.struct("ts", "id", "etag", "modified", "digest", "headers"), response).alias("last"))
    carried = spans.withColumn("carried", F.last("last", ignorenulls=True).over(Window.partitionBy("canonical_url").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))).drop("last")
    r = F.when(F.col("canonical_url").isNotNull(), F.coalesce("near", "carried"))
    met = here.join(carried, ["canonical_url", "range"], "left").withColumn("r", F.when(F.col("is_revisit"), r).otherwise(full))

    def agree(a: str, strip: bool = False) -> Column:
        x, y = F.col(a), F.col(f"r.{a}")
        return F.regexp_replace(x, "^W/", "") == F.regexp_replace(y, "^W/", "") if strip else x == y

    # the first validator that both have decides; null: none in common
    checked = F.coalesce(agree("etag", True), agree("modified"), agree("digest"))
    status = F.when(~F.col("is_revisit"), "response").when(F.col("r").isNull(), "orphan").when(checked.isNull(), "unchecked").when(checked, "resolved").otherwise("mismatch")
    empty = F.create_map().cast("map<string,string>")
    mine, theirs = F.coalesce("headers", empty), F.coalesce("r.headers", empty)
    allowed = F.map_filter(mine, lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(theirs, lambda k, _: ~F.map_contains_key(allowed, k)), allowed)
    found = F.col("status").isin("resolved", "unchecked")
    out = met.withColumn("status", status).withColumn("resolved_id", F.when(found | ~F.col("is_revisit"), F.col("r.id")))
    out = out.withColumn("resolved_digest", F.when(found | ~F.col("is_revisit"), F.col("r.digest")))
    return out.withColumn("merged_headers", F.when(found, merged).when(~F.col("is_revisit"), mine)).select("id", "canonical_url", "status", "resolved_id", "resolved_digest", "merged_headers")


def unchunked(body: bytes) -> bytes:
    """A body without its chunk sizes; as it is, if they are malformed."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size < 0 or end + 2 + size > len(body):
            return body
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def _parsed(raw: bytes) -> Iterator[tuple]:
    """The records of a WARC file: (offset, type, uri, date, id, profile, status, headers, payload). A record without a
    readable length is left out, and reading goes on at the next; a file that breaks off ends there."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(raw)) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)
    try:
        yield from _records(stream)
    except (EOFError, OSError, zlib.error):  # broken off, or no gzip any more
        return


def _records(stream) -> Iterator[tuple]:
    def fields(lines: Iterator[bytes]) -> dict[str, str]:
        out: dict[str, str] = {}
        for line in lines:
            name, colon, value = line.decode("utf-8", "replace").partition(":")
            if colon:
                out[name.strip().lower()] = value.strip()
        return out

    at = 0
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            at = stream.tell()
            continue
        head = fields(iter(lambda: stream.readline().rstrip(b"\r\n"), b""))
        length = head.get("content-length") or "0"
        if not length.isdecimal():
            at = stream.tell()
            continue
        body = stream.read(int(length))
        if len(body) < int(length):
            return
        status, http = None, {}
        if head.get("content-type", "").startswith("application/http"):
            top, _, body = body.partition(b"\r\n\r\n")
            first, *rest = top.split(b"\r\n")
            words = first.split()
            status, http = int(words[1]) if len(words) > 1 and words[1].isdigit() else None, fields(iter(rest))
            if http.get("transfer-encoding", "").lower().endswith("chunked"):
                body = unchunked(body)
        yield at, head.get("warc-type"), head.get("warc-target-uri"), head.get("warc-date"), head.get("warc-record-id"), head.get("warc-profile"), status, http, body
        at = stream.tell()


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of plain or gzipped WARC files; a file, of 1 GB by custom and at most 2 GB, is the unit of work."""
    types = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("type", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("record_id", pa.string()), ("profile", pa.string()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                some: list[tuple] = []
                for record in _parsed(content.as_py()):
                    some.append((file, *record[:7], list(record[7].items()), record[8]))
                    if len(some) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in some], f.type) for k, f in enumerate(types)], schema=types)
                        some = []
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in some], f.type) for k, f in enumerate(types)], schema=types)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, RECORDS)


def captures_of(records: DataFrame) -> DataFrame:
    """Captures from ``read_warc``: full responses and not-modified revisits. Of HTTP only those with status 200 to 299 but
    206 are full."""
    kind, status = F.col("type") == "revisit", F.col("status")
    full = status.isNull() | status.between(200, 299) & (status != 206)
    chosen = records.filter(kind & F.coalesce(F.col("profile").contains("server-not-modified"), F.lit(True)) | (F.col("type") == "response") & full)
    return chosen.select(F.col("record_id").alias("id"), F.col("uri").alias("url"), F.try_to_timestamp("date").alias("ts"), kind.alias("is_revisit"), F.col("headers")["etag"].alias("etag"), F.col("headers")["last-modified"].alias("modified"), F.when(~kind, F.sha2("payload", 256)).alias("digest"), "headers")
