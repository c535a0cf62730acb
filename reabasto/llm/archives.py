"""Legacy web archives (ARC) and their conversion to WARC.

An ARC file holds records of one header line, whose fields depend on the version, and as many bytes as
that line declares:

    version 1: URL IP-address Archive-date Content-type Archive-length
    version 2: URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length

The first record, filedesc:, says which version the file has. The converter reads by declared lengths and
makes up what WARC wants besides: a record identifier (the same in every run, from archive and offset), the
timestamp in ISO form, the record type, payload and block digests. Records whose payload repeats
an earlier one of some size become revisits without payload.

Files are written and read by tasks through the file system of their address, which all executors share.
A record is a gzip member of its own; a file is closed at FILE_BYTES, a record is never split.
Writers name files anew in every attempt and hand on a list of what they wrote, and readers go by that
list, so a lost executor leaves at most files that nobody reads.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reabasto.llm.common import scratch, stage

FILE_BYTES = 16 << 20  # compressed
BATCH_BYTES = 8 << 20  # payload handed to Spark at once
MIN_REVISIT = 100  # smaller payloads are stored again
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122
FIELDS = {
    1: ["url", "ip", "date", "mime", "length"],
    2: ["url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"],
}  # fixed values: field names of the two versions, in order
TITLES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}  # fixed values: as they stand in the files
NO_DATE = "1970-01-01T00:00:00Z"
RECORD = (
    "record_id string, warc_type string, target_uri string, ip string, date string, mime string, status int, "
    "arc_version int, archive string, arc_offset long, page_id long, payload_bytes long, payload_digest string, "
    "header binary, payload binary, error string"
)


# ---- files


def open_folder(address: str):
    """(file system, path) of a shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(address if "://" in address else f"file://{address}")


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Roll:
    """Writes records to archive files of a folder, one after the other.

    encoder(file name) gives the bytes that a file begins with and a function from (record, offset
    so far, uncompressed) to a record's bytes.
    """

    def __init__(self, folder: str, suffix: str, encoder: Callable[[str], tuple[bytes, Callable]]):
        self.system, self.base = open_folder(folder)
        self.system.create_dir(self.base, recursive=True)
        self.suffix, self.encoder, self.out, self.done = suffix, encoder, None, []

    def add(self, record) -> None:
        if self.out is None:
            name = f"{uuid.uuid4().hex}.{self.suffix}.gz"
            head, self.encode = self.encoder(name)
            self.path, self.number = f"{self.base}/{name}", 0
            self.out = self.system.open_output_stream(self.path, compression=None)
            self.out.write(first := _member(head))
            self.size, self.offset = len(first), len(head)
        data = self.encode(record, self.offset)
        self.out.write(packed := _member(data))
        self.size, self.offset, self.number = self.size + len(packed), self.offset + len(data), self.number + 1
        if self.size >= FILE_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None
            self.done.append((self.path, self.number))

    def files(self) -> pd.DataFrame:
        self.close()
        return pd.DataFrame(self.done, columns=["path", "records"])


FILES = "path string, records long"


def records_of(system, path: str, parse: Callable[[BinaryIO, str], Iterable[dict]]) -> Iterator[dict]:
    """The records of a file, as `parse` gives them from a stream of uncompressed bytes and a file name."""
    with system.open_input_stream(path, compression=None) as raw:
        start = raw.read(2)
    with system.open_input_stream(path, compression=None) as raw:
        stream = gzip.GzipFile(fileobj=raw) if start == b"\x1f\x8b" else raw
        yield from parse(io.BufferedReader(stream, 1 << 18), path.rpartition("/")[2])


def read_files(files: DataFrame, folder: str, parse: Callable[[BinaryIO, str], Iterable[dict]], schema: str, tasks: int) -> DataFrame:
    """The records of listed files. A task holds a batch of about BATCH_BYTES, not a file."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = open_folder(folder)
        rows, size = [], 0
        for batch in batches:
            for path in batch["path"]:
                for record in records_of(system, path, parse):
                    rows.append(record)
                    size += len(record.get("payload") or b"") + 500
                    if size >= BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return files.select("path").repartition(tasks, "path").mapInPandas(run, schema)


# ---- ARC


def arc_date(iso: str) -> str:
    return "".join(c for c in iso if c.isdigit())[:14]


def arc_encoder(version: int | None, date: str) -> Callable[[str], tuple[bytes, Callable]]:
    """Encoder of pages (page_id, url, html); version None: 1 or 2 by the file's name."""

    def begin(name: str) -> tuple[bytes, Callable]:
        kind = version or 1 + int(name[0], 16) % 2
        about = f"{kind} 0 Archive\n{TITLES[kind]}\n".encode()
        line = f"filedesc://{name} 0.0.0.0 {date} text/plain" + (f" 200 - - 0 {name}" if kind == 2 else "") + f" {len(about)}\n"

        def encode(page, offset: int) -> bytes:
            payload = (page.html or "").encode("utf-8", "surrogatepass")
            known = "" if page.page_id is None else f"X-Page-Id: {page.page_id}\r\n"
            body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}\r\n{known}\r\n".encode() + payload
            url = arc_url(page.url)
            if kind == 2:
                check = hashlib.md5(body).hexdigest()
                head = f"{url} 0.0.0.0 {date} text/html 200 {check} - {offset} {name} {len(body)}\n"
            else:
                head = f"{url} 0.0.0.0 {date} text/html {len(body)}\n"
            return head.encode("utf-8", "surrogatepass") + body + b"\n"

        return line.encode() + about + b"\n", encode

    return begin


def arc_url(url: str | None) -> str:
    """A URL as one field: white space and control characters percent-encoded; none: a name of its own."""
    if not url:
        return "unknown:"
    return "".join(f"%{ord(c):02X}" if ord(c) <= 32 or ord(c) == 127 else "".join(f"%{b:02X}" for b in c.encode()) if c.isspace() else c for c in url)


def iso_date(digits: str) -> str:
    """14 digits, or fewer from the right, as an ISO timestamp; anything else: the epoch."""
    if not digits.isdigit() or len(digits) not in (4, 6, 8, 10, 12, 14):
        return NO_DATE
    d = digits + "00000101000000"[len(digits) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def parse_arc(stream: BinaryIO, archive: str) -> Iterator[dict]:
    """Records of an ARC file, converted. What can't be read ends the file with one row that has an error and no payload."""
    version, offset = 0, 0
    while line := stream.readline():
        start, offset = offset, offset + len(line)
        if not line.strip():
            continue
        text = line.decode("utf-8", "surrogatepass").rstrip("\r\n")
        about = not version  # the record that says which version the file has
        try:
            if about:
                if not text.startswith("filedesc:"):
                    raise ValueError("no filedesc record at the beginning")
                version = 2 if len(text.split(" ")) >= len(FIELDS[2]) else 1
            parts = text.rsplit(" ", len(FIELDS[version]) - 1)
            if len(parts) < len(FIELDS[version]):
                raise ValueError(f"{len(parts)} fields in a record of version {version}")
            record = dict(zip(FIELDS[version], parts, strict=True))
            content = stream.read(int(record["length"]))
            if len(content) < int(record["length"]):
                raise ValueError(f"{len(content)} of {record['length']} bytes")
        except ValueError as e:
            yield _converted(archive, start, version, {}, b"") | {"warc_type": "error", "error": str(e)}
            return
        offset += len(content)
        if not about:
            yield _converted(archive, start, version, record, content)


def _converted(archive: str, offset: int, version: int, record: dict, content: bytes) -> dict:
    """What a WARC record needs, made from an ARC record."""
    url = record.get("url", "")
    header, payload, status = b"", content, record.get("status", "")
    http = content.startswith(b"HTTP/") and record.get("mime") != "text/dns"
    if http:
        header, found, payload = content.partition(b"\r\n\r\n")
        header += found
        status = header.split(b" ", 2)[1].decode("ascii", "replace") if b" " in header else ""
    known = http_fields(header).get("x-page-id", "")
    return {
        "record_id": str(uuid.uuid5(NAMESPACE, f"{archive}#{offset}")),
        "warc_type": "response" if http else "resource",
        "target_uri": url,
        "ip": record.get("ip", ""),
        "date": iso_date(record.get("date", "")),
        "mime": record.get("mime", ""),
        "status": int(status) if status.isdigit() else None,
        "arc_version": version,
        "archive": archive,
        "arc_offset": offset,
        "page_id": int(known) if known.lstrip("-").isdigit() else None,
        "payload_bytes": len(payload),
        "payload_digest": hashlib.sha256(payload).hexdigest(),
        "header": header,
        "payload": payload,
        "error": None,
    }


def http_fields(header: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in header.split(b"\r\n")[1:])
    return {k.strip().lower().decode("latin-1"): v.strip().decode("latin-1") for k, _, v in pairs if k.strip()}


# ---- WARC


def warc_encoder(name: str) -> tuple[bytes, Callable]:
    about = b"format: WARC File Format 1.1\r\n"
    first = warc_record(
        {
            "WARC-Type": "warcinfo",
            "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(NAMESPACE, name)}>",
            "WARC-Date": NO_DATE,
            "WARC-Filename": name,
            "Content-Type": "application/warc-fields",
        },
        about,
    )

    def encode(record: dict, _: int) -> bytes:
        """record: of RECORD; one that repeats another has `refers` with record_id, target_uri and date of that one."""
        refers = record.get("refers")
        block = record["header"] + (b"" if refers else record["payload"])
        fields = {
            "WARC-Type": "revisit" if refers else record["warc_type"],
            "WARC-Record-ID": f"<urn:uuid:{record['record_id']}>",
            "WARC-Date": record["date"],
            "WARC-Target-URI": record["target_uri"],
            "WARC-IP-Address": record["ip"],
            "WARC-Payload-Digest": f"sha256:{record['payload_digest']}",
            "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        }
        if refers:
            fields |= {
                "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                "WARC-Refers-To": f"<urn:uuid:{refers['record_id']}>",
                "WARC-Refers-To-Target-URI": refers["target_uri"],
                "WARC-Refers-To-Date": refers["date"],
            }
        fields["Content-Type"] = "application/http;msgtype=response" if record["header"] else record["mime"]
        return warc_record(fields, block)

    return first, encode


def warc_record(fields: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


WARC = (
    "record_id string, record_type string, target_uri string, date string, page_id long, payload_bytes long, "
    "payload_digest string, refers_id string, whole boolean, payload binary"
)


def parse_warc(stream: BinaryIO, archive: str, payloads: bool = True) -> Iterator[dict]:
    """Records of a WARC file but warcinfo. whole: the digests in the record are those of its bytes."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{archive}: no record where one should begin")
        fields = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            fields[key.strip().lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if fields["warc-type"] == "warcinfo":
            continue
        http = fields.get("content-type", "").startswith("application/http")
        header, _, payload = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
        inner, revisit = http_fields(header), fields["warc-type"] == "revisit"
        declared = fields.get("warc-payload-digest", "").removeprefix("sha256:")
        digest = declared if revisit else hashlib.sha256(payload).hexdigest()
        known = inner.get("x-page-id", "")
        yield {
            "record_id": _bare(fields["warc-record-id"]),
            "record_type": fields["warc-type"],
            "target_uri": fields.get("warc-target-uri"),
            "date": fields.get("warc-date"),
            "page_id": int(known) if known.lstrip("-").isdigit() else None,
            "payload_bytes": int(inner.get("content-length") or 0) if revisit else len(payload),
            "payload_digest": digest,
            "refers_id": _bare(fields["warc-refers-to"]) if revisit else None,
            "whole": digest == declared and fields.get("warc-block-digest") == f"sha256:{hashlib.sha256(block).hexdigest()}",
            "payload": payload if payloads else None,
        }


def _bare(identifier: str) -> str:
    return identifier.strip("<>").removeprefix("urn:uuid:")


# ---- tables


def write_arc(pages: DataFrame, folder: str, version: int | None = None, date: str = "20200101000000") -> DataFrame:
    """Pages (page_id, url, html) as ARC files; the list of files. Null html: an empty payload; null page_id or url: none in the record."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roll = Roll(folder, "arc", arc_encoder(version, date))
        for batch in batches:
            for page in batch.itertuples(index=False):
                roll.add(page)
        yield roll.files()

    return stage(pages.select(F.col("page_id").cast("string"), "url", "html").mapInPandas(run, FILES), "files")


def convert(arcs: DataFrame, arc_folder: str, warc_folder: str, first: Column | None = None, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """ARC files as WARC files; the list of files.

    Of records whose payloads are equal and at least `min_revisit` bytes, the first by `first` (columns of
    RECORD; the identifier decides ties) keeps its payload, the others become revisits of it. Records
    that couldn't be read are left out; errors() lists them.

    Equal payloads meet as digests, counted on the map side, so a payload that most pages share is no
    single task's work. Payloads themselves are not moved: a task reads a file again with the list
    of its revisits, no longer than the file has records, and writes its records as it reads them.
    """
    records = read_files(arcs, arc_folder, _without_payload(parse_arc), RECORD, _tasks(arcs)).where("error is null")
    place = F.struct(first if first is not None else F.lit(0), "record_id", "target_uri", "date")
    light = stage(records.select("archive", "arc_offset", "record_id", "payload_digest", "payload_bytes", place.alias("place")), "digests")
    big = light.where(F.col("payload_bytes") >= min_revisit)
    lowest = big.groupBy("payload_digest").agg(F.min("place").alias("one"), F.count("*").alias("n")).where("n > 1")
    again = big.join(lowest, "payload_digest").where("record_id <> one.record_id")
    entry = F.struct("arc_offset", "one.record_id", "one.target_uri", "one.date")
    per_file = again.groupBy("archive").agg(F.collect_list(entry).alias("revisits"))
    listed = arcs.withColumn("archive", F.substring_index("path", "/", -1)).join(per_file, "archive", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roll = Roll(warc_folder, "warc", warc_encoder)
        system, _ = open_folder(arc_folder)
        for batch in batches:
            for path, revisits in zip(batch["path"], batch["revisits"], strict=True):
                refers = {r["arc_offset"]: r for r in (revisits if revisits is not None else ())}
                for record in records_of(system, path, parse_arc):
                    if record["error"] is None:
                        roll.add(record | {"refers": refers.get(record["arc_offset"])})
        yield roll.files()

    return stage(listed.select("path", "revisits").repartition(_tasks(arcs), "path").mapInPandas(run, FILES), "files")


def _without_payload(parse: Callable[[BinaryIO, str], Iterable[dict]]) -> Callable[[BinaryIO, str], Iterator[dict]]:
    return lambda stream, name: ({**r, "payload": None, "header": None} for r in parse(stream, name))


def errors(arcs: DataFrame, arc_folder: str) -> DataFrame:
    """What the converter couldn't read: archive, arc_offset, error."""
    return read_files(arcs, arc_folder, parse_arc, RECORD, _tasks(arcs)).where("error is not null").select("archive", "arc_offset", "error")


def read_warc(warcs: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Records of WARC files, columns of WARC."""
    return read_files(warcs, folder, lambda stream, name: parse_warc(stream, name, payloads), WARC, _tasks(warcs))


def _tasks(files: DataFrame) -> int:
    return max(1, min(files.count(), 100_000))


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Pages through ARC files and the converter to WARC files, read back.

    Per page: page_id, payload_bytes, payload_digest (of the full payload), record_type, refers_to
    (page_id of the record that a revisit points at), target_uri, whole (digests in the file are right). A page with a null id
    comes last among equal ones. Rows that share an id are records of their own. Empty table: no rows.
    """
    folder = folder or scratch(pages.sparkSession, "archives")
    arcs = write_arc(pages, f"{folder}/arc")
    first = F.struct(F.col("page_id").isNull(), F.col("page_id"))
    warcs = convert(arcs, f"{folder}/arc", f"{folder}/warc", first)
    back = stage(read_warc(warcs, f"{folder}/warc", payloads=False).drop("payload"), "records")
    pointed = back.where("record_type <> 'revisit'").select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"))
    return back.join(pointed, "refers_id", "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "whole"
    )
