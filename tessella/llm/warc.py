"""Content-addressed WARC archives.

Writing decides by a verified strong digest (SHA-256 and length) which record of each payload
is the response: the one with the smallest id.  Its archive record carries the payload; the
others are revisits that refer to it.  Records go out through Spark's text writer, a record a
row and CRLF CRLF between them, so any file system that Spark writes to will do and a failed
task's files never appear.

Reading parses the archives by content length as a stream, so what a task holds is a record and
not a file's content, and checks every payload against its digests.  Its rows make two tables:
`payloads` (key, payload), each payload once, and `records` with the exact header of every record
and the key of its payload.  `reconstruct` joins them to the original records.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, near, pick, row_key, same_row, table

HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Bytes of payload that a file should hold, and records at most.
FILE_BYTES, FILE_RECORDS = 32 << 20, 20_000
_GZIP = b"\x1f\x8b"
_PIECE = 1 << 20


def base32_of_hex(hex_: Column) -> Column:
    """Base32 of a digest in hexadecimal whose bits are a multiple of 40: ten hex digits make eight characters."""

    def ten(i: Column) -> Column:
        bits = F.conv(F.substr(hex_, (i * 10 + 1).cast("int"), F.lit(10)), 16, 10).cast("long")
        return F.concat(*[F.substr(F.lit(_BASE32), (F.shiftright(bits, 35 - 5 * k) % 32 + 1).cast("int"), F.lit(1)) for k in range(8)])

    return F.array_join(F.transform(F.sequence(F.lit(0), (F.length(hex_) / 10 - 1).cast("int")), ten), "")


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), "[\r\n]", " "), F.lit("\r\n"))).otherwise("")


def write_archive(records: DataFrame, path: str, min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """(record_id, uri, payload binary) -> WARC files under `path`, one archive record for each row.

    A null payload is empty, a null uri gives no target line, a null id is named `null`.  Payloads
    below min_revisit_bytes are always responses; of equal ones the smallest id is the response.
    Rows that share both id and payload are all responses.  Very long payloads are written
    whole, in files of fewer records.  No rows give an archive without records.
    """
    rows = pick(records, "record_id", "uri", "payload").select(F.col("record_id").cast("long").alias("id"), "uri", F.coalesce("payload", F.lit(b"")).alias("payload"))
    rows = rows.withColumn("rk", row_key("payload"))
    with Workspace(records.sparkSession, "warc-plan") as ws:
        digests = ws.save(rows.select("rk", "id", F.sha2("payload", 256).alias("key"), F.octet_length("payload").alias("size")), "digests")
        n, size = digests.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
        per_file = max(1, min(FILE_RECORDS, FILE_BYTES * n // max(size, 1)))
        long_ = digests.where(F.col("size") >= min_revisit_bytes)
        # Written first: a join of two plain shuffles, which AQE splits where many records are alike.
        first = ws.save(long_.groupBy("key", "size").agg(F.min("id").alias("refers_to"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"), "first")
        later = ws.save(long_.join(first, ["key", "size"]).where("id <> refers_to").select("id", "rk", "refers_to").distinct(), "revisits")
        later = near(later)
        rows = rows.join(later, same_row(rows, later), "left").select(rows["*"], "refers_to")
        revisit = F.col("refers_to").isNotNull()
        name = lambda c: F.concat(F.lit("<urn:record:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
        length = F.when(revisit, F.lit(len(HTTP))).otherwise(F.octet_length("payload") + len(HTTP))
        header = F.concat(
            F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), _line("WARC-Record-ID", name(F.col("id"))), _line("WARC-Date", F.lit(date)),
            _line("WARC-Target-URI", F.col("uri")), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.sha1("payload")))), _line("Payload-Key", F.concat(F.lit("sha256:"), F.sha2("payload", 256))),
            F.when(revisit, F.concat(_line("WARC-Refers-To", name(F.col("refers_to"))), _line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
            _line("Content-Type", F.lit("application/http;msgtype=response")), _line("Content-Length", length), F.lit("\r\n"), F.lit(HTTP),
        )
        body = F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string"))
        rows.select(F.concat(header, body).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).option("maxRecordsPerFile", per_file).text(path)


def inflated(content: memoryview) -> Iterator[bytes]:
    """The bytes of a file in pieces: gzip of any number of members, or as they are."""
    if bytes(content[:2]) != _GZIP:
        for at in range(0, len(content), _PIECE):
            yield bytes(content[at : at + _PIECE])
        return
    member, at, left = zlib.decompressobj(31), 0, b""
    while left or at < len(content):
        if not left:
            left, at = bytes(content[at : at + _PIECE]), at + _PIECE
        if member.eof:
            if left[:1] == b"\0" and not left.strip(b"\0"):  # padding after the last member
                left = b""
                continue
            member = zlib.decompressobj(31)
        out = member.decompress(left, _PIECE)
        left = member.unused_data if member.eof else member.unconsumed_tail
        if out:
            yield out
    if not member.eof:
        raise ValueError("a gzip member is cut short")


def parse_warc(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(fields, exact header bytes, block) of each record; raises on a record cut short.  Holds one record at a time."""
    held, at, place = bytearray(), 0, 0
    source = iter(pieces)

    def more() -> bool:
        nonlocal at, place
        piece = next(source, None)
        if piece is None:
            return False
        if at:
            del held[:at]
            place += at
            at = 0
        held.extend(piece)
        return True

    while True:
        if at == len(held) and not more():
            return
        seek = at
        while (end := held.find(b"\r\n\r\n", seek)) < 0:
            back = max(len(held) - 3, at) - at
            if not more():
                raise ValueError(f"no WARC record at byte {place + at}")
            seek = at + back
        lines = bytes(held[at:end]).split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {place + at}")
        fields = {k.decode().lower(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines[1:])}
        header, whole = end + 4 - at, end + 4 - at + int(fields["content-length"])
        while len(held) - at < whole + 4 and more():
            pass
        if held[at + whole : at + whole + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {place + at} is cut short")
        yield fields, bytes(held[at : at + header]), bytes(held[at + header : at + whole])
        at += whole + 4


_READ = pa.schema([("record_name", pa.string()), ("record_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.string()), ("uri", pa.string()), ("header", pa.binary()), ("payload", pa.binary()), ("payload_digest", pa.string()), ("key", pa.string())])
READ = "record_name string, record_id long, record_type string, refers_to string, uri string, header binary, payload binary, payload_digest string, key string"


def _number(name: str | None) -> int | None:
    """The id in a record name as written here; other names (UUIDs, say) have none."""
    text = (name or "").removeprefix("<urn:record:").removesuffix(">")
    return int(text) if text.removeprefix("-").isdecimal() else None


def _row(path: str, fields: dict[str, str], header: bytes, block: bytes) -> tuple:
    kind, name = fields["warc-type"], fields["warc-record-id"]
    digest, key = fields.get("warc-payload-digest", ""), fields.get("payload-key", "").removeprefix("sha256:") or None
    payload = None
    if kind != "revisit":
        payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
        own = hashlib.sha256(payload).hexdigest()
        sha1 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if digest.startswith("sha1:") and sha1 != digest[5:] or key not in (None, own):
            raise ValueError(f"{path}: payload of {name} does not match its digest")
        key, digest = own, digest or f"sha1:{sha1}"
    return name, _number(name), kind, fields.get("warc-refers-to"), fields.get("warc-target-uri"), header, payload, digest.removeprefix("sha1:"), key


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
            rows: list[tuple] = []
            held = 0
            for fields, header, block in parse_warc(inflated(memoryview(content.as_buffer()))):
                rows.append(_row(path, fields, header, block))
                held += len(header) + len(block)
                if held > 4 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[] for _ in _READ]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, _READ, strict=True)], schema=_READ)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row for each archive record; the payload is null for revisits.  Gzip files may have a member for each record."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_read, READ)


def content_store(archive: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """(records, payloads), both written: exact headers with the key of each payload, and each payload once.

    A revisit takes the key of the record it refers to; where it states one of its own, or a
    digest, these must agree.  A revisit that refers to nothing in the archive raises.
    """
    cols = ["record_name", "record_id", "record_type", "refers_to", "uri", "header", "payload_digest", "key"]
    archive = ws.save(archive, "read")
    full = archive.where("payload is not null").select("key", "payload")
    # Keys of several responses (repeated rows, other writers' archives) are found without their payloads, which stay where they are.
    many = near(ws.save(full.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("key"), "many"))
    once = full.join(many, "key", "left_semi").groupBy("key").agg(F.first("payload").alias("payload"))
    payloads = ws.save(full.join(many, "key", "left_anti").unionByName(once), "payloads")
    own = archive.select(*cols)
    asked = own.where("record_type = 'revisit'").select(F.col("refers_to").alias("name")).distinct()
    to = own.where("record_type <> 'revisit'").join(asked, F.col("record_name") == F.col("name"), "left_semi")
    # A name may stand for several rows (a repeated id); which of them is told by the digest.
    to = ws.save(to.select(F.col("record_name").alias("name"), F.col("payload_digest").alias("d"), F.col("key").alias("k")).distinct(), "named")
    met = own.join(to, (own["record_type"] == "revisit") & (own["refers_to"] == to["name"]) & (own["payload_digest"] == to["d"]), "left")
    bad = F.raise_error(F.lit("a revisit refers to no record with its digest")).cast("string")
    key = F.when(F.col("record_type") != "revisit", F.col("key")).when(F.col("k").isNotNull() & F.coalesce(F.col("key") == F.col("k"), F.lit(True)), F.col("k")).otherwise(bad)
    records = ws.save(met.select(*cols[:-1], key.alias("key")), "records")
    ws.drop("read")
    return records, payloads


def reconstruct(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """The records with their payloads in full: a join of two written tables, which AQE splits where one payload is hot."""
    return records.join(payloads, "key").drop("key")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived, read back and reconstructed from the content-addressed store.

    A null html is an empty payload; very long ones, ties and repeated rows as `write_archive`
    has them: of equal payloads the smallest page_id is the response.  An empty table gives none.
    """
    pages = pick(table(spark, sf_dir, "pages"), "page_id", "url", "html").select(F.col("page_id").alias("record_id"), F.col("url").alias("uri"), F.col("html").cast("binary").alias("payload"))
    with Workspace(spark, "warc") as ws:
        write_archive(pages, ws.path("archive"))
        records, payloads = content_store(read_archive(spark, ws.path("archive")), ws)
        ws.drop("archive")
        rows = reconstruct(records.select("record_id", "record_type", "refers_to", "payload_digest", "key"), payloads)
        sha1 = base32_of_hex(F.sha1("payload"))
        digest = F.when(sha1 == F.col("payload_digest"), sha1).otherwise(F.raise_error(F.lit("a reconstructed payload does not match its record")).cast("string"))
        to = F.regexp_extract("refers_to", r"^<urn:record:(-?\d+)>$", 1).cast("long")
        return rows.select(F.col("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", to.alias("refers_to")).checkpoint()


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS x, sha256(h) AS k FROM p),
f AS (SELECT k, min(page_id) AS first FROM d GROUP BY k)
SELECT d.page_id, d.payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(d.x, CAST((i // 4) * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - (i % 4) * 5 AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN d.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN d.page_id <> f.first THEN f.first END AS refers_to
FROM d JOIN f USING (k)
"""
