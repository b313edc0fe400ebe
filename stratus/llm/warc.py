"""WARC archives: a writer with revisit records, and a splittable reader.

Writing. Each record is a gzip member of its own. Of records with equal payloads of at
least ``least_bytes`` bytes, the one with the largest id is a response and the others are
revisits: they carry the payload's digest, its length (in the HTTP header that they
repeat) and the response's record id, but no payload. The choice is made on (id, digest,
length) alone: only digests that occur more than once are joined back, in a join that
Spark broadcasts if that table is small and that AQE splits if one payload is hot.

Reading. A file is cut into byte ranges, and a task scans its range for the gzip magic.
A candidate counts only if it decodes as a gzip member that starts with a WARC header
whose Content-Length is the rest of the member. A range owns the records that start in
it; the last may end beyond it. From one member the next begins where it ends, and the
scan starts anew after damaged bytes, which are skipped.

Defined cases: a null payload is empty; a null or repeated id is kept as it is (of equal
payloads, every row with the largest id is a response; payloads that only null ids have
are all responses); a null URL has no target header; line breaks in a URL are
percent-encoded; columns other than id, URL and payload aren't stored; an empty table
writes no archive and reads as empty.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratus.llm.common import new_folder, written
from stratus.llm.files import NewFile, opened
from stratus.llm.tokens import slices

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
FILE_BYTES, SPLIT_BYTES, READ_BYTES = 1 << 30, 32 << 20, 1 << 18


# ---- records ----------------------------------------------------------------------------


def _name(key: int | None) -> str:
    return f"<urn:page:{'' if key is None else key}>"


def _key(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """A gzip member with one record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(key)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    head += ["WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode(), "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    zipped = zlib.compressobj(6, zlib.DEFLATED, 31)
    return zipped.compress(data) + zipped.flush()


def parse(data: bytes) -> dict | None:
    """The fields of a decoded member; None if it is no whole WARC record."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not lines[0].startswith(b"WARC/1."):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines[1:])}
    size = fields.get("content-length", "")
    if not size.isdigit() or len(rest) != int(size) + 4 or not rest.endswith(b"\r\n\r\n"):
        return None
    http, _, payload = rest[:-4].partition(b"\r\n\r\n")
    sent = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in http.split(b"\r\n")[1:])}
    kind, digest = fields.get("warc-type"), fields.get("warc-payload-digest", "")
    stated = base64.b32decode(digest.removeprefix("sha1:")).hex() if digest.startswith("sha1:") else None
    return {
        "page_id": _key(fields.get("warc-record-id")),
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "payload": None if kind == "revisit" else payload,
        "payload_bytes": int(sent["content-length"]) if kind == "revisit" else len(payload),
        "payload_digest": stated if kind == "revisit" else hashlib.sha1(payload).hexdigest(),
        "refers_to": _key(fields.get("warc-refers-to")) if kind == "revisit" else None,
    }


class Bytes:
    """A window on a file that grows forward and drops what was passed."""

    def __init__(self, file, at: int):
        self.file, self.begin, self.data = file, at, b""
        file.seek(at)

    def upto(self, end: int) -> None:
        """Reads on until the window reaches ``end`` or the file's end."""
        while self.begin + len(self.data) < end and (more := self.file.read(READ_BYTES)):
            self.data += more

    def drop(self, at: int) -> None:
        self.data, self.begin = self.data[at - self.begin :], at


def member(window: Bytes) -> tuple[bytes, int] | None:
    """(content, end) of the gzip member at the window's begin, None if it is none."""
    unzip, out, at = zlib.decompressobj(31), [], 0
    try:
        while not unzip.eof:
            if at == len(window.data):
                window.upto(window.begin + at + 1)
                if at == len(window.data):
                    return None
            out.append(unzip.decompress(window.data[at : at + READ_BYTES]))
            at = min(at + READ_BYTES, len(window.data))
            if len(out) == 1 and out[0] and not b"WARC/1.".startswith(out[0][:7]) and not out[0].startswith(b"WARC/1."):
                return None
    except zlib.error:
        return None
    return b"".join(out), window.begin + at - len(unzip.unused_data)


def records(file, start: int, end: int) -> Iterator[dict]:
    """The records that start at a byte from ``start`` to before ``end``."""
    window = Bytes(file, start)
    while window.begin < end:
        window.upto(min(window.begin + READ_BYTES, end + len(MAGIC) - 1))
        found = window.data.find(MAGIC)
        if found < 0:
            if not window.data or window.begin + len(window.data) >= end:
                return
            window.drop(max(window.begin + 1, window.begin + len(window.data) - len(MAGIC) + 1))
            continue
        if window.begin + found >= end:
            return
        window.drop(window.begin + found)
        got = member(window)
        row = parse(got[0]) if got else None
        if row:
            yield row
        window.drop(got[1] if row else window.begin + 1)


# ---- Spark ------------------------------------------------------------------------------


def write_warc(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 1000, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes archives into ``folder`` (by default a new one in the shared folder) and
    returns the manifest: path, n_records, n_bytes."""
    to = folder or new_folder(pages.sparkSession, "warc")
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    keys = rows.filter(F.octet_length("payload") >= least_bytes).select("id", "digest")
    first = keys.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("response")).filter("n > 1 AND response IS NOT NULL")
    first = written(first.select(F.col("digest").alias("d"), "response"), "warc-copies")
    chosen = rows.join(first, F.col("digest") == F.col("d"), "left").select("id", "url", "payload", "response")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, n, done = None, 0, []
        for b in (x.slice(a, z - a) for x in batches for a, z in slices(x.column(2))):
            for key, url, body, response in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if file is None:
                    file, n = NewFile(to, ".warc.gz"), 0
                revisit = response is not None and key != response
                file.write(record(key, url, body, response, revisit))
                n += 1
                if file.size >= file_bytes:
                    file.close()
                    done.append((file.uri, n, file.size))
                    file = None
        if file is not None:
            file.close()
            done.append((file.uri, n, file.size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["path", "n_records", "n_bytes"])

    return written(chosen.mapInArrow(save, "path string, n_records long, n_bytes long"), "warc-manifest")


READ = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def read_warc(files: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """A row per record of the archives in ``files`` (path, n_bytes). A revisit's payload
    is null, its length and digest those of the payload it refers to."""
    names = [x.split()[0] for x in READ.split(", ") if with_payload or not x.startswith("payload ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in READ.split(", ") if x.split()[0] in names])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.to_pylist():
                rows, held = [], 0
                with opened(x["path"]) as file:
                    for r in records(file, x["first"], min(x["first"] + split_bytes, x["n_bytes"])):
                        rows.append({k: r[k] for k in names})
                        held += 200 + len(r["payload"] or b"") * with_payload
                        if held >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    ranges = files.filter("n_bytes > 0").select("path", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1, F.lit(split_bytes).cast("long"))).alias("first"))
    return ranges.repartition(max(1, ranges.count())).mapInArrow(load, ", ".join(x for x in READ.split(", ") if x.split()[0] in names))


def query(spark, sf_dir: str) -> DataFrame:
    archives = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_warc(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
x AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest FROM p),
y AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS response FROM x)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response THEN response END AS refers_to
FROM y
"""
