"""WARC archives: a record per row, and a reader that salvages damaged ones (operator 13).

Writing: each record is a gzip member of its own. Of rows with equal payloads of at least
``LEAST_BYTES`` bytes that of the largest id is a ``response``, the others are ``revisit`` records
that refer to it and carry its digest and HTTP header but no payload. Which is which comes from
payload hashes grouped before payloads move: only hashes with copies are joined back. Spark's own
text writer writes the members (with an empty gzip member, which every reader passes over, as its
line separator), so its commit protocol holds and any store that Spark writes to will do.

Reading: an archive (plain, a member a record, or members of several records) is read as one value
and walked through. A member must inflate to its checksum; a record must have a version line, a
length, its closing line ends, and the digests that it names. After a failed check the reader looks
for the next position at which a member or a version line passes all checks, goes on there, and
logs the bytes in between as a gap. Archives are written in bounded numbers of records, as a task
holds one at a time.

Defined results: a null payload is the empty one; a null id makes records that never count as the
largest (where all ids are null, all are responses); rows that share the largest id are all
responses; a null address becomes the record's id, and spaces, controls and non-ASCII characters in
addresses are percent-encoded; an empty table gives an archive without records. Other columns of
the input are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from seriesforge.llm.common import shared_folder, small_batches, written
from seriesforge.sources.publish import hidden_beside, publish

LEAST_BYTES = 1000
RECORDS_PER_FILE = 2000
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
STARTS = re.compile(rb"\x1f\x8b\x08|(?<![^\n])WARC/1\.[01]\r\n")
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = "path string, kind string, offset long, inner_offset long, length long, record_type string, record_id string, refers_to string, uri string, date string, payload_bytes long, payload_digest string, payload binary"


def with_leaders(rows: DataFrame, row_id: str, payload: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Adds ``__leader``: the largest id of the rows with the same payload of ``least_bytes`` or more, where
    there are several; else null. ``payload`` is binary and not null."""
    keyed = rows.withColumn("__key", F.unhex(F.sha2(payload, 256)))
    large = keyed.where(F.octet_length(payload) >= least_bytes)
    leaders = large.groupBy("__key").agg(F.max(row_id).alias("__leader"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    return keyed.join(written(leaders, "leaders"), "__key", "left").drop("__key")


def labelled(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(row_id: str | None, uri: str | None, payload: bytes | None, n_bytes: int, digest: bytes, refers_to: str | None, date: str) -> bytes:
    """A whole record, not compressed; ``digest`` is the SHA-1 of the full payload. With ``refers_to`` it is
    a revisit."""
    own = f"<urn:row:{quote(row_id or '', safe='')}>"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    if refers_to is None:
        block += payload or b""
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", own),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(uri, safe="!#$%&'()*+,/:;=?@[]~") if uri else own[1:-1]),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()),
        ("WARC-Block-Digest", labelled(block)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:row:{quote(refers_to, safe='')}>"), ("WARC-Profile", REVISIT)]
    fields.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def write_archives(rows: DataFrame, goal: str, row_id: str, uri: str, payload: str, date: str = "1970-01-01T00:00:00Z", least_bytes: int = LEAST_BYTES, records_per_file: int = RECORDS_PER_FILE) -> list[str]:
    """Writes a record for each row to ``*.warc.gz`` files of a new folder ``goal``; returns their names."""
    spark = rows.sparkSession
    small_batches(spark)
    full = rows.select(F.col(row_id).alias("id"), F.col(uri).cast("string").alias("uri"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    full = with_leaders(full, "id", "payload", least_bytes)
    revisit = F.col("__leader").isNotNull() & ~F.col("__leader").eqNullSafe(F.col("id"))
    slim = full.select(
        F.col("id").cast("string").alias("id"), "uri",
        F.when(~revisit, F.col("payload")).alias("payload"),
        F.octet_length("payload").cast("long").alias("n_bytes"),
        F.unhex(F.sha1("payload")).alias("digest"),
        F.when(revisit, F.col("__leader").cast("string")).alias("refers_to"),
    )

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [gzip.compress(record(*row, date), 6, mtime=0) for row in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], ["member"])

    hidden = hidden_beside(goal)
    text = slim.mapInArrow(members, "member binary").select(F.col("member").cast("string").alias("value"))
    text.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("maxRecordsPerFile", records_per_file).text(hidden)
    run = uuid4().hex[:8]
    number = re.compile(r"part-(\d+)-.*?(?:-c(\d+))?\.txt$")
    return publish(spark, hidden, goal, lambda f: f"{run}-{m[1]}-{m[2] or '000'}.warc.gz" if (m := number.search(f)) else None)


def sha1_of(label: str) -> bytes | None:
    """The digest of a label as base32 or hex; None if it isn't a SHA-1's."""
    kind, _, value = label.partition(":")
    try:
        found = (base64.b32decode(value.upper()) if len(value) == 32 else bytes.fromhex(value)) if kind.lower() == "sha1" else b""
    except ValueError:
        return None
    return found if len(found) == 20 else None


def record_at(data: bytes, at: int) -> tuple[int, dict] | None:
    """(end, fields of READ) of the record at ``at``; None if a check fails."""
    top = VERSION.match(data, at)
    blank = data.find(b"\r\n\r\n", top.end() - 2) if top else -1
    if blank < 0:
        return None
    head: dict[str, str] = {}
    for line in data[top.end() : blank].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if line and not colon:
            return None
        head[name.strip().lower()] = value.strip()
    length = head.get("content-length", "")
    if not re.fullmatch("[0-9]{1,15}", length):
        return None
    first, end = blank + 4, blank + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        return None
    block = data[first:end]
    payload, http = block, b""
    if head.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
    is_revisit = head.get("warc-type") == "revisit"
    for name, body in (("warc-block-digest", block), ("warc-payload-digest", None if is_revisit else payload)):
        if body is not None and (want := sha1_of(head.get(name, ""))) and want != hashlib.sha1(body).digest():
            return None
    full = re.search(rb"(?im)^content-length: *([0-9]{1,15})\r?$", http) if is_revisit else None
    digest = sha1_of(head.get("warc-payload-digest", "")) if is_revisit else hashlib.sha1(payload).digest()
    return end + 4, {
        "record_type": head.get("warc-type"),
        "record_id": head.get("warc-record-id"),
        "refers_to": head.get("warc-refers-to"),
        "uri": head.get("warc-target-uri"),
        "date": head.get("warc-date"),
        "payload_bytes": (int(full[1]) if full else None) if is_revisit else len(payload),
        "payload_digest": digest.hex() if digest else None,
        "payload": None if is_revisit else payload,
    }


def member_at(data: bytes, at: int) -> tuple[int, bytes] | None:
    """(end, content) of the gzip member at ``at``; None if it isn't whole or its checksum fails."""
    inflate, parts, step = zlib.decompressobj(31), [], 1 << 16
    try:
        for a in range(at, len(data), step):
            parts.append(inflate.decompress(data[a : a + step]))
            if inflate.eof:
                return min(a + step, len(data)) - len(inflate.unused_data), b"".join(parts)
    except zlib.error:
        pass
    return None


def salvaged(data: bytes, inside: bool = False) -> Iterator[dict]:
    """Records of an archive and the gaps between them, by position."""
    at = gap = 0
    while at < len(data):
        rows: list[dict] | None = None
        if data[at : at + 3] == b"\x1f\x8b\x08":
            if not inside and (member := member_at(data, at)):
                end, content = member
                rows = [{**row, "inner_offset": row["offset"], "offset": at} for row in salvaged(content, True)]
        elif found := record_at(data, at):
            end, fields = found
            rows = [{"kind": "record", "offset": at, "length": end - at, **fields}]
        if rows is None:
            ahead = STARTS.search(data, at + 1)
            at = ahead.start() if ahead else len(data)
            continue
        if gap < at:
            yield {"kind": "gap", "offset": gap, "length": at - gap}
        yield from rows
        at = gap = end
    if gap < len(data):
        yield {"kind": "gap", "offset": gap, "length": len(data) - gap}


def read_archives(spark: SparkSession, folder: str, payloads: bool = True, rows_per_batch: int = 64) -> DataFrame:
    """The records of all ``*.warc*`` files below ``folder`` and, with kind ``gap``, the byte ranges that no
    valid record covers (``offset`` is the file's, ``inner_offset`` the inflated member's)."""
    small_batches(spark)
    names = [f.partition(" ")[0] for f in READ.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    types = [kinds[f.partition(" ")[2]] for f in READ.split(", ")]

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*batch.columns):
                rows = []
                for row in salvaged(content.as_py()):
                    rows.append({**row, "path": path.as_py()} | ({} if payloads else {"payload": None}))
                    if len(rows) == rows_per_batch:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInArrow(read, READ)


def row_of(record_id):
    """The id that ``write_archives`` has put into a record's URN; null if it was null."""
    own = F.regexp_extract(record_id, "^<urn:row:(.*)>$", 1)
    return F.when(own != "", F.url_decode(own))


def op13_warc(spark, sf_dir: str) -> DataFrame:
    """All ``pages`` written as records and read back from the archives."""
    goal = f"{shared_folder(spark)}/archives-{uuid4().hex}"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), goal, "page_id", "url", "html")
    records = read_archives(spark, goal, payloads=False).where("kind = 'record'")
    return records.select(
        row_of("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        row_of("refers_to").cast("long").alias("refers_to"),
    )


OP13_SQL = """
WITH rows AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages
), leaders AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 AND max(page_id) OVER (PARTITION BY html) IS DISTINCT FROM page_id THEN max(page_id) OVER (PARTITION BY html) END AS refers_to FROM rows
)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM leaders
"""
