"""Web archives: legacy ARC files written, converted to WARC records, and read back, all by Spark's own files.

Archives are written by Spark's text sink: a row is a gzip member that holds a record, and the line
separator is a gzip member that holds what stands between records. So files appear whole or not at
all, in any file system that Spark reaches, whatever becomes of executors.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The record definitions of both versions, as their version blocks state them.
DEFINITIONS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
NO_ADDRESS, DATE = "0.0.0.0", "20000101000000"
KEY_FIELD = "X-Record-Key"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK, HEAD = 1 << 14, 1 << 16
MEMBER = "archive long, place long, member binary"


def gzipped(data: bytes, level: int = 2) -> bytes:
    """One gzip member."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def packed(data: bytes) -> bytes:
    """For the way through a shuffle: the length and the data, compressed by zstd."""
    return len(data).to_bytes(8, "big") + pa.compress(data, "zstd", asbytes=True)


def unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "big"), "zstd", asbytes=True)


class Bytes:
    """The text of an archive, read front to back: a plain one, or gzip members that are inflated as they are needed."""

    def __init__(self, data: bytes):
        self.data, self.at, self.packed, self.held = data, 0, data[:2] == b"\x1f\x8b", bytearray()
        self.inflate = zlib.decompressobj(31) if self.packed else None

    def fill(self, size: int) -> bool:
        """Whether ``size`` bytes are held; a broken or cut member ends the text."""
        while len(self.held) < size and self.at < len(self.data):
            piece = self.data[self.at:self.at + CHUNK]
            self.at += len(piece)
            if not self.packed:
                self.held += piece
                continue
            while piece:
                try:
                    self.held += self.inflate.decompress(piece)
                except zlib.error:
                    self.at = len(self.data)
                    break
                piece = self.inflate.unused_data
                if self.inflate.eof:
                    self.inflate = zlib.decompressobj(31)
        return len(self.held) >= size

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the text, and for a line beyond 64 KB."""
        size = 1024
        while (end := self.held.find(b"\n")) < 0 and self.fill(len(self.held) + size) and len(self.held) < HEAD:
            size *= 2
        end = self.held.find(b"\n")
        if end < 0:
            if not self.held or len(self.held) > HEAD:
                return None
            end = len(self.held)
        found = bytes(self.held[:end])
        del self.held[:end + 1]
        return found.rstrip(b"\r")

    def take(self, size: int) -> bytes:
        self.fill(size)
        found = bytes(self.held[:size])
        del self.held[:size]
        return found


class ArcRecord(NamedTuple):
    """A record of an ARC file: the fields that its header line names, and as much of the declared bytes as there are."""

    ordinal: int
    fields: dict[str, str]
    block: bytes
    declared: int
    error: str | None = None


def arc_records(data: bytes) -> Iterator[ArcRecord]:
    """The records after the version block of an ARC file.

    The version block says which version the lines have; its own definition of the fields counts where it
    gives one. Fields are taken from the right, since a URL may hold blanks. Bytes are taken as declared,
    whatever they hold; a line that has no length ends the file with a record that says so.
    """
    text, fields, ordinal = Bytes(data), None, 0
    while (line := text.line()) is not None:
        if not line:
            continue
        if fields is None:
            parts = line.rsplit(b" ", 4)
            if not line.startswith(b"filedesc:") or not parts[-1].isdigit():
                yield ArcRecord(0, {}, b"", 0, "no version block")
                return
            block = text.take(int(parts[-1])).decode("latin-1").splitlines()
            version = int(block[0].split()[0]) if block and block[0].split() and block[0].split()[0].isdigit() else 0
            told = block[1].split() if len(block) > 1 and block[1].startswith("URL ") else []
            fields = told or DEFINITIONS.get(version, "").split()
            if not fields or fields[-1] != "Archive-length":
                yield ArcRecord(0, {}, b"", 0, f"version {version} is not known")
                return
            continue
        values = line.decode("utf-8", "replace").rsplit(" ", len(fields) - 1)
        if len(values) != len(fields) or not values[-1].isdigit():
            yield ArcRecord(ordinal, {}, b"", 0, "no record line")
            return
        declared = int(values[-1])
        block = text.take(declared)
        yield ArcRecord(ordinal, dict(zip(fields, values)), block, declared)
        ordinal += 1


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """The headers of an HTTP message with their blank line, and its payload; no headers where it is none."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    ends = [(at + len(mark), at) for mark in (b"\r\n\r\n", b"\n\n") if (at := block.find(mark)) >= 0]
    cut = min(ends, key=lambda e: e[1])[0] if ends else len(block)
    return block[:cut], block[cut:]


def http_field(head: bytes, name: str) -> str | None:
    for line in head.splitlines()[1:]:
        key, colon, value = line.partition(b":")
        if colon and key.strip().lower() == name.lower().encode():
            return value.strip().decode("utf-8", "replace")
    return None


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_date(arc_date: str) -> str:
    """An ARC date of 14 digits, or a shorter older one, as a WARC date; the start of 1970 for anything else."""
    digits = arc_date if arc_date.isdigit() else ""
    digits = digits[:14] + "00000101000000"[len(digits):14] if len(digits) >= 4 else ""
    try:
        return datetime.strptime(digits, "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def warc_record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A WARC record up to its block's end; fields without a value are left out."""
    lines = [b"WARC/1.1"] + [f"{k}: {v}".encode() for k, v in [*fields, ("Content-Length", str(len(block)))] if v is not None]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record; reading ends at a line that starts none."""
    text = Bytes(data)
    while (line := text.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            return
        fields, last = {}, None
        while line := text.line():
            if line[:1] in b" \t" and last:
                fields[last] += " " + line.strip().decode("utf-8", "replace")
                continue
            key, _, value = line.partition(b":")
            last = key.strip().decode("latin-1").lower()
            fields[last] = value.strip().decode("utf-8", "replace")
        yield fields, text.take(int(fields["content-length"]) if fields.get("content-length", "").isdigit() else 0)


def members(batches, start, record, file_bytes: int):
    """The gzip members of a task's archives, about ``file_bytes`` each before compression.

    ``start(archive)`` makes what an archive begins with, and ``record`` a record of a row.
    """
    archive, place, size = 0, 0, 0
    found = [(0, 0, gzipped(start(0)))]
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for row in batch.slice(at, 256).to_pylist():
                if size >= file_bytes:
                    archive, place, size = archive + 1, 0, 0
                    found.append((archive, 0, gzipped(start(archive))))
                data = record(row, archive)
                place, size = place + 1, size + len(data)
                found.append((archive, place, gzipped(data)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found)], ["archive", "place", "member"])
            found = []
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found)], ["archive", "place", "member"])


def write_members(rows: DataFrame, path: str, between: bytes) -> None:
    """Files of members in their order, each followed by the gzip member of ``between``; rows stay in their tasks."""
    text = rows.sortWithinPartitions("archive", "place").select("archive", F.col("member").cast("string").alias("value"))
    text.write.partitionBy("archive").option("lineSep", gzipped(between).decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def write_arc(pages: DataFrame, path: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html",
              versions: tuple[int, ...] = (1, 2), file_bytes: int = 32_000_000) -> None:
    """ARC files of the pages, of about ``file_bytes`` bytes before compression, written where the pages lie; versions take turns.

    A record is an HTTP response whose field X-Record-Key holds the id. A null url is
    ``urn:none``; blanks, controls and other characters that a header line cannot hold are escaped.
    """
    key = F.col(id_column).cast("string")
    payload = F.coalesce(F.col(payload_column).cast("binary"), F.lit(b""))
    rows = pages.select(key.alias("key"), F.coalesce(F.col(url_column).cast("string"), F.lit("")).alias("url"), payload.alias("payload"))

    def version_of(archive: int) -> int:
        return versions[(TaskContext.get().partitionId() + archive) % len(versions)]

    def start(archive: int) -> bytes:
        about = f"{version_of(archive)} 0 converter\n{DEFINITIONS[version_of(archive)]}\n\n".encode()
        return f"filedesc://pages.arc {NO_ADDRESS} {DATE} text/plain {len(about)}\n".encode() + about

    def record(row: dict, archive: int) -> bytes:
        head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (f"{KEY_FIELD}: {row['key']}\r\n" if row["key"] is not None else "")
        block = f"{head}Content-Length: {len(row['payload'])}\r\n\r\n".encode() + row["payload"]
        more = f" 200 - - 0 pages.arc {len(block)}\n" if version_of(archive) == 2 else f" {len(block)}\n"
        url = quote(row["url"], safe="!#$%&'()*+,/:;=?@[]~-._") or "urn:none"
        return f"{url} {NO_ADDRESS} {DATE} text/html".encode() + more.encode() + block

    write_members(rows.mapInArrow(lambda batches: members(batches, start, record, file_bytes), MEMBER), path, b"\n")


RECORD = ("archive string, ordinal long, record_id string, url string, date string, address string, mime string, "
          "key string, kind string, same binary, digest string, declared long, head binary, payload binary, error string")
RECORD_NAMES = [field.split()[0] for field in RECORD.split(", ")]


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the ARC files: what its line says, and what its WARC form is called.

    ``record_id`` is made of the archive's name, the place in it and the digest, so that reading
    twice gives the same. ``kind`` is response for HTTP and DNS answers and else resource. ``same`` tells payloads apart (SHA-256), ``digest`` is
    the WARC form (base32 SHA-1). ``payload`` is packed (zstd); without ``payloads`` it and the headers are null. A file or rest of a file
    that cannot be read is one row with an ``error``.
    """

    def rows(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                path, found, size = path.as_py(), [], 0
                for r in arc_records(content.as_py()):
                    head, payload = http_parts(r.block)
                    digest = base32_sha1(payload)
                    url = r.fields.get("URL", "")
                    kind = "response" if head or url.startswith("dns:") else "resource"
                    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{path.rsplit('/', 1)[-1]}#{r.ordinal} {digest}")
                    error = r.error or ("cut short" if len(r.block) < r.declared else None)
                    found.append((path, r.ordinal, f"<urn:uuid:{name}>", url, warc_date(r.fields.get("Archive-date", "")),
                                  r.fields.get("IP-address"), r.fields.get("Content-type"), http_field(head, KEY_FIELD), kind,
                                  hashlib.sha256(payload).digest(), digest, r.declared, head if payloads else None,
                                  packed(payload) if payloads else None, error))
                    size += len(payload)
                    if size > 8_000_000 or len(found) >= 2000:
                        yield pa.RecordBatch.from_pylist([dict(zip(RECORD_NAMES, x)) for x in found], schema)
                        found, size = [], 0
                if found:
                    yield pa.RecordBatch.from_pylist([dict(zip(RECORD_NAMES, x)) for x in found], schema)

    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[f.split()[1]]) for n, f in zip(RECORD_NAMES, RECORD.split(", "))])
    return read_files(spark, path).mapInArrow(rows, RECORD)


def convert_archives(spark: SparkSession, arc: str, warc: str, least_bytes: int = 0, file_bytes: int = 32_000_000) -> DataFrame:
    """WARC files in the folder ``warc`` for the ARC files in ``arc``; returns the rows that could not be read.

    Of responses whose payloads are equal and have at least ``least_bytes`` bytes, that with the smallest key (as
    a number; without one last) stays, others are revisits that name it: they have its digest and their own
    headers, and no payload. The first of each payload is found from digests alone, by minima
    that combine before the shuffle; then each record, packed, meets its first once, a join in which
    adaptive execution splits a payload that very many share. A record cut short says so (WARC-Truncated).
    """
    short = read_arc(spark, arc, payloads=False)
    number = F.expr("try_cast(key AS decimal(38,0))")
    place = F.struct(number.isNull().alias("none"), number.alias("number"), F.coalesce("key", F.lit("")).alias("key"), "record_id", "url", "date")
    sharing = "kind = 'response' AND declared > 0 AND error IS NULL"
    firsts = short.filter(sharing).groupBy("same").agg(F.min(place).alias("first"))
    rows = read_arc(spark, arc).filter("error IS NULL OR error = 'cut short'")
    met = rows.join(firsts.hint("shuffle_hash"), "same", "left").withColumns({
        "first_id": F.col("first.record_id"), "first_url": F.col("first.url"), "first_date": F.col("first.date")}).select(
        "record_id", "url", "date", "address", "mime", "kind", "digest", "head", "payload", "error", "first_id", "first_url", "first_date")

    def start(archive: int) -> bytes:
        about = b"software: archive converter\r\nformat: WARC File Format 1.1\r\n"
        name = uuid.uuid5(uuid.NAMESPACE_URL, f"{warc}#{TaskContext.get().partitionId()}#{archive}")
        info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", warc_date(DATE)), ("Content-Type", "application/warc-fields")]
        return warc_record(info, about)

    def record(r: dict, archive: int) -> bytes:
        payload = unpacked(r["payload"])
        again = r["kind"] == "response" and not r["error"] and r["first_id"] not in (None, r["record_id"]) and len(payload) >= least_bytes
        fields = [("WARC-Type", "revisit" if again else r["kind"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Date", r["date"]),
                  ("WARC-Target-URI", r["url"]), ("WARC-IP-Address", r["address"] if r["address"] not in (None, NO_ADDRESS, "-") else None),
                  ("WARC-Payload-Digest", f"sha1:{r['digest']}")]
        if again:
            fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", r["first_id"]), ("WARC-Refers-To-Target-URI", r["first_url"]),
                       ("WARC-Refers-To-Date", r["first_date"])]
        block = r["head"] if again else r["head"] + payload
        fields += [("WARC-Truncated", "unspecified" if r["error"] else None), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
                   ("Content-Type", "application/http; msgtype=response" if r["head"] else r["mime"] or "application/octet-stream")]
        return warc_record(fields, block)

    write_members(met.mapInArrow(lambda batches: members(batches, start, record, file_bytes), MEMBER), warc, b"\r\n\r\n")
    return short.filter("error IS NOT NULL").select("archive", "ordinal", "error")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record_type, url, date, key, payload_bytes, payload_digest, refers_to_id, sound) of each record.

    Bytes and digest of a record that holds its payload are taken from the payload; ``sound`` is whether the digests that
    the record states agree. A revisit has the digest that it states, and null bytes. warcinfo records are left out.
    """
    names = ["record_id", "record_type", "url", "date", "key", "payload_bytes", "payload_digest", "refers_to_id", "sound"]

    def rows(batches):
        for batch in batches:
            for content in batch.column(0):
                found = []
                for fields, block in warc_records(content.as_py()):
                    kind = fields.get("warc-type", "")
                    if kind == "warcinfo":
                        continue
                    head, payload = http_parts(block)
                    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    digest = stated if kind == "revisit" else base32_sha1(payload)
                    sound = stated in (None, digest) and fields.get("warc-block-digest", "").removeprefix("sha1:") in ("", base32_sha1(block))
                    found.append((fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("warc-date"), http_field(head, KEY_FIELD),
                                  None if kind == "revisit" else len(payload), digest, fields.get("warc-refers-to"), sound))
                    if len(found) >= 5000:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in found], schema)
                        found = []
                if found:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in found], schema)

    schema = pa.schema([(n, {"payload_bytes": pa.int64(), "sound": pa.bool_()}.get(n, pa.string())) for n in names])
    return read_files(spark, path).select("content").mapInArrow(rows, "record_id string, record_type string, url string, date string, key string, "
                                                                "payload_bytes long, payload_digest string, refers_to_id string, sound boolean")


def archived_pages(pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html",
                   least_bytes: int = 0, file_bytes: int = 32_000_000) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to, sound) of pages that went through ARC and WARC files below ``folder``.

    Null texts and urls are empty; an id may be null, and comes last among equal payloads; an id that is there twice is two records. Very long
    texts are records like others (a file is read whole by one task, so a payload has to fit there). An empty
    table gives files without records and no rows. Columns besides the three are not read.
    """
    spark = pages.sparkSession
    write_arc(pages, f"{folder}/arc", id_column, url_column, payload_column, file_bytes=file_bytes)
    convert_archives(spark, f"{folder}/arc", f"{folder}/warc", least_bytes, file_bytes)
    found = read_warc(spark, f"{folder}/warc")
    kind = pages.schema[id_column].dataType.simpleString()
    first = found.filter("record_type <> 'revisit'").select(F.col("record_id").alias("refers_to_id"), F.col("key").alias("first_key"), F.col("payload_bytes").alias("first_bytes"))
    again = found.filter("record_type = 'revisit'").join(first, "refers_to_id", "left")

    def columns(df, size, refers_to):
        return df.select(F.col("key").cast(kind).alias(id_column), size.alias("payload_bytes"), "payload_digest", "record_type", refers_to.cast(kind).alias("refers_to"), "sound")

    return columns(found.filter("record_type <> 'revisit'"), F.col("payload_bytes"), F.lit(None).cast("string")).unionByName(
        columns(again, F.col("first_bytes"), F.col("first_key")))
