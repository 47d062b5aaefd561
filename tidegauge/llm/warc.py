"""WARC archives of pages: writing, reading, and captures as nested rows.

Each page is a transaction of three records: a request, a response (or a revisit
that refers to an equal payload), and metadata. Request and metadata name the
response's record in ``WARC-Concurrent-To``, and may lie in other archives than
it. Reading takes records from all archives, joins them by these identifiers and
gives one nested row per capture.

Responses are written first; the table of what was written gives each later equal
payload the full identifier of a response record that exists.

A null payload is empty. Missing page ids, urls and repeated rows are captures of
their own; of equal payloads every row with the smallest id is a response, and others
refer to one of these. A very long payload is one record like others. An empty table
gives no archives and an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import query, table
from tidegauge.llm.files import create, locate, new_name
from tidegauge.session import materialise, scratch_path

#: Payloads below this size are written each.
LEAST = 100
#: A task begins another archive after so many bytes of payload.
ARCHIVE_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
RECORD = (
    "record_id string, type string, concurrent_to string, refers_to string, target string, headers map<string,string>, "
    "payload_digest string, payload_bytes long, page_id long, fields map<string,string>"
)


def with_roles(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, digest, size`` and ``first_id``: the smallest page id of an equal payload of some size."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    # Digests alone are grouped and joined; payloads follow in one shuffle, a frequent digest split by the join.
    repeated = rows.where(F.col("size") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    return rows.join(repeated.where("n > 1").drop("n"), "digest", "left")


def _block(kind: str, record_id: str, headers: dict[str, str], content_type: str, content: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    lines += [f"{k}: {v}" for k, v in headers.items() if v is not None]
    lines += [f"Content-Type: {content_type}", f"Content-Length: {len(content)}", "", ""]
    return "\r\n".join(lines).encode() + content + b"\r\n\r\n"


def _one_line(text: str | None) -> str | None:
    """A header's value can't hold line ends; they are written as a browser sends them."""
    return None if text is None else text.replace("\r", "%0D").replace("\n", "%0A")


def transaction(key: str, page_id, url, payload: bytes | None, size: int, digest: str, first_key: str | None) -> list[bytes]:
    """Request, response or revisit, and metadata of one page."""
    target = _one_line(url)
    own, to = f"urn:capture:{key}", f"<urn:capture:{key}>"
    path = (target or "").partition("://")[2].partition("/")[2]
    request = f"GET /{path} HTTP/1.1\r\n\r\n".encode()
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    held = {"WARC-Target-URI": target, "WARC-Payload-Digest": f"sha256:{digest}"}
    if first_key is None:
        main = _block("response", own, held, "application/http; msgtype=response", status + payload)
    else:
        held |= {"WARC-Refers-To": f"<urn:capture:{first_key}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
        main = _block("revisit", own, held, "application/http; msgtype=response", status)
    fields = f"page-id: {'' if page_id is None else page_id}\r\npayload-bytes: {size}\r\n".encode()
    return [
        _block("request", f"urn:request:{key}", {"WARC-Target-URI": target, "WARC-Concurrent-To": to}, "application/http; msgtype=request", request),
        main,
        _block("metadata", f"urn:metadata:{key}", {"WARC-Target-URI": target, "WARC-Concurrent-To": to}, "application/warc-fields", fields),
    ]


def _written(rows: DataFrame, folder: str, kind: str) -> DataFrame:
    """Write ``page_id, url, payload, size, digest, refers_to, shared`` and return a row per archive, and per record others may refer to.

    A record is a gzip member of its own, as archives have it. Rows are numbered as they
    are written, so identifiers are those of the archives that count.
    """

    def run(batches):
        out, size, name = None, 0, None
        for batch in batches:
            known = []
            for page_id, url, payload, length, digest, refers_to, shared, number in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = new_name(folder, kind) + ".warc.gz"
                    out, size = create(name), 0
                # Unique among all captures, and begins with the page.
                key = f"{'none' if page_id is None else page_id}.{kind}.{number}"
                for record in transaction(key, page_id, url, payload, length, digest, refers_to):
                    packed = zlib.compressobj(3, wbits=31)
                    out.write(packed.compress(record) + packed.flush())
                if shared:
                    known.append((None, digest, key))
                size += len(payload or b"")
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    known.append((name, None, None))
            if known:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*known)], names=["path", "digest", "key"])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in (name, None, None)], names=["path", "digest", "key"])

    numbered = rows.select("page_id", "url", "payload", "size", "digest", "refers_to", "shared", F.monotonically_increasing_id().alias("number"))
    return materialise(numbered.mapInArrow(run, "path string, digest string, key string"), "archives")


def write_archives(pages: DataFrame) -> DataFrame:
    """Write every page's records to gzipped archives and return ``path`` of each."""
    folder = scratch_path(pages.sparkSession, "warc")
    rows = with_roles(pages)
    # The smallest id of a payload is its response; of repeated ids, each of them.
    responds = F.col("first_id").isNull() | F.col("page_id").eqNullSafe(F.col("first_id"))
    shared = F.col("first_id").isNotNull()
    first = _written(rows.where(responds).withColumns({"refers_to": F.lit(None).cast("string"), "shared": shared}), folder, "response")
    keys = first.where("digest IS NOT NULL").groupBy("digest").agg(F.min("key").alias("refers_to"))
    again = rows.where(~responds).withColumns({"payload": F.lit(None).cast("binary"), "shared": F.lit(False)}).join(keys, "digest")
    revisits = _written(again, folder, "revisit")
    return first.union(revisits).where("path IS NOT NULL").select("path")


def records(path: str):
    """Headers and content of the records of one archive, as a stream."""
    store, place = locate(path)
    with store.open_input_stream(place, compression="gzip" if path.endswith(".gz") else None) as raw, io.BufferedReader(raw, 1 << 20) as file:
        while True:
            line = file.readline()
            if not line:
                return
            if not line.strip():
                continue
            headers = {}
            while (line := file.readline()).strip():
                name, _, value = line.decode().partition(":")
                headers[name.strip().lower()] = value.strip()
            yield headers, file.read(int(headers["content-length"]))


def read_records(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per record of all archives; response payloads only on request.

    The digest of a response is taken from its payload and must agree with its header.
    """
    tasks = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = RECORD + (", payload binary" if payloads else "")

    def row(headers, content):
        kind = headers["warc-type"]
        payload = content.partition(b"\r\n\r\n")[2] if kind == "response" else None
        digest = headers.get("warc-payload-digest", "").rpartition(":")[2] or None
        if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload of {headers['warc-record-id']} does not match its digest")
        fields = dict(x.split(": ", 1) for x in content.decode().splitlines() if ": " in x) if kind == "metadata" else {}
        made = [
            headers["warc-record-id"].strip("<>"), kind, headers.get("warc-concurrent-to", "").strip("<>") or None,
            headers.get("warc-refers-to", "").strip("<>") or None, headers.get("warc-target-uri"), list(headers.items()), digest,
            int(fields["payload-bytes"]) if "payload-bytes" in fields else None,
            int(fields["page-id"]) if fields.get("page-id", "").strip() else None, list(fields.items()),
        ]
        return made + ([payload] if payloads else [])

    def run(batches):
        text, pairs = pa.string(), pa.map_(pa.string(), pa.string())
        kinds = [text, text, text, text, text, pairs, text, pa.int64(), pa.int64(), pairs, *([pa.binary()] if payloads else [])]
        names = "record_id type concurrent_to refers_to target headers payload_digest payload_bytes page_id fields payload".split()[: len(kinds)]

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                held = []
                for record in records(path):
                    held.append(row(*record))
                    if len(held) == 2000:
                        yield made(held)
                        held = []
                if held:
                    yield made(held)

    return archives.select("path").repartition(tasks, "path").mapInArrow(run, schema)


def captures(found: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit with the request and metadata concurrent to it.

    Records meet by the identifier of the response, their own or the one they are
    concurrent to, so the archives are read and shuffled once.
    """
    kept = ["record_id", "target", "headers"]
    main = [c for c in found.columns if c not in ("concurrent_to", "page_id", "payload_bytes", "fields")]

    def of(kinds: list[str], columns: list[str], name: str):
        return F.first(F.when(F.col("type").isin(kinds), F.struct(*columns)), ignorenulls=True).alias(name)

    capture = F.when(F.col("type").isin("request", "metadata"), F.col("concurrent_to")).otherwise(F.col("record_id"))
    rows = found.withColumn("capture", capture).groupBy("capture").agg(
        of(["response", "revisit"], main, "response"), of(["request"], kept, "request"),
        of(["metadata"], [*kept, "page_id", "payload_bytes", "fields"], "metadata"),
    )
    return rows.where("response IS NOT NULL")


@query(
    "op8_warc_round_trip",
    """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
            q AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS d, min(page_id) OVER (PARTITION BY h) AS f FROM p)
       SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
              CASE WHEN n >= 100 AND f <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
              CASE WHEN n >= 100 AND f <> page_id THEN f END AS refers_to
       FROM q""",
)
def op8(spark, sf_dir):
    found = captures(read_records(write_archives(table(spark, sf_dir, "pages"))))
    return found.select(
        "metadata.page_id", "metadata.payload_bytes", "response.payload_digest", F.col("response.type").alias("record_type"),
        F.regexp_extract("response.refers_to", r"urn:capture:(-?\d+)", 1).try_cast("long").alias("refers_to"),
    )
