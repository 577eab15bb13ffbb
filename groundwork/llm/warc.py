"""WARC archives: a writer with revisit records and a reader that salvages what damage leaves."""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from .common import shared_dir

CRLF, END, MEMBER = b"\r\n", b"\r\n\r\n", b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/\d\.\d\r\n")
_WHOLE = re.compile(r"[0-9]{1,18}")
_CLEAN = r"[\r\n]+"


def with_revisits(pages: DataFrame, *, key: str = "page_id", payload: str = "html", least_bytes: int = 100) -> DataFrame:
    """key, url, payload (null: empty), payload_bytes, payload_digest (SHA-256), refers_to (null: a response).

    Payloads are compared by digest; counts are pre-aggregated, and only digests that stand more than once and have ``least_bytes`` are
    joined back, where Spark splits a digest with many rows. Rows that share the smallest key are all responses. A row
    with a null key is a response unless a record with a key has its payload.
    """
    rows = pages.select(F.col(key), F.col("url").cast("string").alias("url") if "url" in pages.columns else F.lit("").alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2(F.col("payload").cast("binary"), 256)})
    seen = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.count("*").alias("_n"), F.min(key).alias("_first"))
    seen = seen.where("_n > 1").drop("_n")
    rows = rows.join(seen, "payload_digest", "left")
    return rows.select(key, "url", "payload", "payload_bytes", "payload_digest", F.when(~F.col(key).eqNullSafe(F.col("_first")), F.col("_first")).alias("refers_to"))


def record_text(key: Column) -> Column:
    """A WARC/1.1 record without its closing blank lines; the block of a response is an HTTP message, that of a revisit is empty."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), F.col("payload"))
    block = F.when(F.col("refers_to").isNull(), http).otherwise(F.lit(""))
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("refers_to").isNull(), F.lit("response")).otherwise(F.lit("revisit"))),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), name(key), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(name(F.col("url")), _CLEAN, " ")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.concat(F.lit("WARC-Block-Digest: sha256:"), F.sha2(block.cast("binary"), 256)),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.when(F.col("refers_to").isNotNull(), F.concat(F.lit("WARC-Refers-To: <urn:page:"), name(F.col("refers_to")), F.lit(">"))),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block)


def _member(record: bytes) -> bytes:
    """A gzip member of this record without its last byte, which is zero; a record of 16 MB or more is followed by an empty member, so that it is."""
    out = gzip.compress(record, 6, mtime=0)
    return (out if len(record) < 1 << 24 else out + gzip.compress(b"", mtime=0))[:-1]


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            yield pa.RecordBatch.from_arrays([pa.array([_member(r + END) for r in batch.column(0).slice(at, 500).to_pylist()], pa.binary())], names=["value"])


def write_archives(pages: DataFrame, path: str, *, key: str = "page_id", records_per_file: int = 10000, compression: str | None = "gzip") -> None:
    """Writes ``with_revisits`` rows as WARC files of at most ``records_per_file`` records, by Spark's own text sink, so that it runs on any
    store and is retried and committed like any Spark output.

    With gzip every record is a member of its own, so damage costs only the records it touches. The sink ends each row with a separator: a
    member's last byte, always zero, or else the two CRLFs that end a plain record.
    """
    rows, end = pages.select(record_text(F.col(key)).alias("value")), "\r\n\r\n"
    if compression == "gzip":
        rows, end = rows.select(F.col("value").cast("binary")).mapInArrow(_members, "value binary").select(F.col("value").cast("string")), "\0"
    writer = rows.write.option("lineSep", end).option("maxRecordsPerFile", records_per_file)
    (writer.option("compression", compression) if compression and compression != "gzip" else writer).text(path)


@dataclass
class Salvage:
    """Records and gaps of one archive. A gap is (offset, length, reason) in bytes of the unpacked archive, or of the packed one for damaged members."""

    records: list[tuple[dict[str, str], bytes, int]] = field(default_factory=list)
    gaps: list[tuple[int, int, str]] = field(default_factory=list)


def _opens(data: bytes, at: int) -> bool:
    """Whether a gzip member that begins with a record begins here."""
    try:
        return bool(_VERSION.match(zlib.decompressobj(31).decompress(data[at : at + (1 << 16)], 16)))
    except zlib.error:
        return False


def _packed(data: bytes) -> bool:
    """Whether members hold the records: the first record that can be read, anywhere in the archive, is in one."""
    if data.startswith(MEMBER):
        return True
    plain = _VERSION.search(data)
    at = data.find(MEMBER, 0, plain.start() if plain else len(data))
    while at >= 0 and not _opens(data, at):
        at = data.find(MEMBER, at + 1, plain.start() if plain else len(data))
    return at >= 0


def _next_member(data: bytes, start: int) -> int:
    """Where the next member that begins with a record begins, or the archive's end."""
    at = data.find(MEMBER, start)
    while at >= 0 and not _opens(data, at):
        at = data.find(MEMBER, at + 1)
    return at if at >= 0 else len(data)


def unpack(data: bytes) -> Iterator[tuple[bytes, list[tuple[int, int, str]]]]:
    """The plain runs of an archive: itself, or each gzip member; a damaged or cut member gives what inflates and a gap up to the next one that opens."""
    if not _packed(data):
        yield data, []
        return
    at = data.find(MEMBER)
    if at:
        yield b"", [(0, at, "no member")]
    while at < len(data):
        inflater, out, gap = zlib.decompressobj(31), [], []
        pos = at
        try:
            while pos < len(data) and not inflater.eof:
                out.append(inflater.decompress(data[pos : pos + (1 << 16)]))
                pos += 1 << 16
            if inflater.eof:
                end = min(pos, len(data)) - len(inflater.unused_data)
            else:
                end = _next_member(data, at + 1)
                gap = [(at, end - at, "member is cut")]
        except zlib.error:
            end = _next_member(data, at + 1)
            gap = [(at, end - at, "member is damaged")]
        yield b"".join(out), gap
        at = end if data.startswith(MEMBER, end) or end >= len(data) else data.find(MEMBER, end)
        if at < 0:
            yield b"", [(end, len(data) - end, "no member")]
            return
        if at > end:
            yield b"", [(end, at - end, "no member")]


def parse(run: bytes, salvage: Salvage) -> None:
    """Adds the records of a plain run. A record counts if its headers parse, its block has its length and end, and its block digest holds;
    else the bytes up to the next version line that opens a record go to the gaps."""
    at, bad, why = 0, -1, ""
    while at < len(run):
        found, reason = _record(run, at)
        if found:
            if bad >= 0:
                salvage.gaps.append((bad, at - bad, why))
                bad = -1
            headers, block, end = found
            salvage.records.append((headers, block, at))
            at = end
            continue
        if bad < 0:
            bad, why = at, reason
        nearby = _VERSION.search(run, at + 1)
        at = nearby.start() if nearby else len(run)
    if bad >= 0:
        salvage.gaps.append((bad, len(run) - bad, why))


def _record(run: bytes, at: int) -> tuple[tuple[dict[str, str], bytes, int] | None, str]:
    if not _VERSION.match(run, at):
        return None, "no version line"
    head = run.find(END, at)
    if head < 0:
        return None, "headers have no end"
    headers = {}
    for line in run[at:head].split(CRLF)[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None, "a header has no colon"
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not _WHOLE.fullmatch(headers.get("content-length", "")):
        return None, "no length"
    if headers.get("warc-type") == "revisit" and not _WHOLE.fullmatch(headers.get("x-payload-length", "0")):
        return None, "payload length is no number"
    start = head + len(END)
    end = start + int(headers["content-length"])
    if run[end : end + 4] != END:
        return None, "block has no end"
    block = run[start:end]
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha256:") and hashlib.sha256(block).hexdigest() != digest[7:]:
        return None, "block digest differs"
    return (headers, block, end + 4), ""


def salvage_archive(data: bytes) -> Salvage:
    """What an archive holds."""
    out = Salvage()
    for found in _salvaged(data):
        out.records += found.records
        out.gaps += found.gaps
    return out


def _salvaged(data: bytes) -> Iterator[Salvage]:
    """The same, plain run after plain run."""
    for run, gaps in unpack(data):
        out = Salvage(gaps=list(gaps))
        parse(run, out)
        yield out


RECORDS = "path string, kind string, record_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary, at long, length long, reason string"
_TYPES = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.string()]


def read_archives(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """Rows of kind ``record`` and ``gap`` from every archive under ``path``, one archive at a time in memory, so keep archives to some 100 MB.

    A record whose checks fail is skipped to the next member or version line, and the bytes between are a gap row with offset,
    length and reason. A response's payload is hashed anew; a revisit's length and digest come from its headers. With
    ``payloads`` off, payloads are checked and hashed but not returned.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORDS.split(", ")]
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, held, gaps = [], 0, []
                for headers, block, at in (r for found in _salvaged(data.as_py()) for r in (gaps.extend(found.gaps), found.records)[1]):
                    kind = headers.get("warc-type", "")
                    payload = block.partition(END)[2] if kind == "response" else block
                    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    if kind == "revisit":
                        size, digest = int(headers.get("x-payload-length", size)), headers.get("warc-payload-digest", "").removeprefix("sha256:")
                    ids = [headers.get(h, "").removeprefix("<urn:page:").removesuffix(">") or None for h in ("warc-record-id", "warc-refers-to")]
                    rows.append((name, "record", ids[0], headers.get("warc-target-uri"), kind, ids[1], size, digest, payload if payloads else None, at, len(block), None))
                    held += len(payload) + 1000
                    if held > 1 << 24:
                        yield _batch(rows, names)
                        rows, held = [], 0
                rows += [(name, "gap", None, None, None, None, None, None, None, at, n, why) for at, n, why in gaps]
                if rows:
                    yield _batch(rows, names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("length") > 0).select("path", "content").mapInArrow(read, RECORDS)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=names)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` as archives in the shared folder and reads the records back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html: an empty payload. Null page_id: null again. Equal payloads under 100 bytes are all responses. Repeated rows give repeated records.
    No rows: no rows. Other columns are not archived. Bytes that can't be read are logged as rows of type gap, without page_id and digest, payload_bytes being how many.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/groundwork-{uuid.uuid4().hex}/archives"
    write_archives(with_revisits(pages), path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return pages_read(spark, path, pages.schema["page_id"].dataType)


def pages_read(spark: SparkSession, path: str, kind: DataType) -> DataFrame:
    """``round_trip``'s columns of the archives under ``path``."""
    rows = read_archives(spark, path, payloads=False)
    return rows.select(
        F.col("record_id").try_cast(kind).alias("page_id"),
        F.coalesce("payload_bytes", "length").alias("payload_bytes"),
        "payload_digest",
        F.coalesce("record_type", "kind").alias("record_type"),
        F.col("refers_to").try_cast(kind).alias("refers_to"),
    )
