"""WARC records in ZIP packages: written by tasks, read back by byte ranges without extraction.

A package is a ZIP archive that stores (doesn't compress) `archive/*.warc[.gz]` members, each record a gzip member of its
own, with CDXJ indexes of their records beside them. The reader parses the end record, its ZIP64 form and the central
directory, finds where stored members begin, cuts them at record boundaries that the index names, and reads each such
range by offset in a task of its own. Records that the index doesn't name are read too, as ranges meet.

Packages are files of any store that pyarrow opens (local or mounted folders, HDFS, S3, GCS). Which ones count is told
by the table of packages that `write_packages` returns; what a lost task has left behind isn't in it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph.llm.common import bounded_batches, shared_dir, stash, with_totals

#: Bytes after which a task starts another package, bytes of a range that one call reads, and bytes read at once.
PACKAGE_BYTES, RANGE_BYTES, CHUNK = 256 << 20, 8 << 20, 1 << 16
#: Bytes a task reads, about; compression of a record.
TASK_BYTES, LEVEL = 64 << 20, 4
#: Signatures and fixed lengths of the ZIP format, and its marks for values that are in the ZIP64 form.
END, END64, LOCATOR, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_BYTES, LOCATOR_BYTES, ENTRY_BYTES, LOCAL_BYTES, MOST_COMMENT = 22, 20, 46, 30, 65535
FULL16, FULL32, STORED, DEFLATED = 0xFFFF, 0xFFFFFFFF, 0, 8
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PACKAGES = "archive string, records long, bytes long"
RECORDS = (
    "archive string, offset long, record_type string, record_id string, refers_to_id string, target_uri string, date string, payload_bytes long, "
    "payload_digest string, digest_ok boolean, headers map<string,string>"
)


# --- bytes of a store -------------------------------------------------------------------------------------------------


def located(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI and the path in it; `file:/x` is taken as Hadoop writes it."""
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", uri))


class Source:
    """Bytes of a file by offset."""

    def __init__(self, uri: str):
        store, path = located(uri)
        self._file = store.open_input_file(path)
        self.size = self._file.size()

    def at(self, offset: int, n: int) -> bytes:
        return self._file.read_at(n, offset) if n > 0 else b""

    def close(self) -> None:
        self._file.close()


# --- ZIP directories --------------------------------------------------------------------------------------------------


class Member:
    """A member of a ZIP archive, as its directory tells."""

    def __init__(self, name: str, method: int, size: int, stored_size: int, header: int):
        self.name, self.method, self.size, self.stored_size, self.header = name, method, size, stored_size, header

    def start(self, source: Source) -> int:
        """Where its bytes begin: the local header has lengths of its own."""
        head = source.at(self.header, LOCAL_BYTES)
        if head[:4] != LOCAL:
            raise ValueError(f"{self.name}: no local header at {self.header}")
        name, extra = struct.unpack_from("<HH", head, 26)
        return self.header + LOCAL_BYTES + name + extra


def _end(source: Source) -> tuple[int, int, int]:
    """Number of members, size and place of the central directory."""
    tail_at = max(0, source.size - END_BYTES - MOST_COMMENT)
    tail = source.at(tail_at, source.size - tail_at)
    at = tail.rfind(END)
    while at >= 0 and (at + END_BYTES > len(tail) or at + END_BYTES + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at)  # the mark may stand in a comment
    if at < 0:
        raise ValueError("not a ZIP archive: no end record")
    disk, first_disk, _, count, size, place = struct.unpack_from("<HHHHII", tail, at + 4)
    locator = source.at(tail_at + at - LOCATOR_BYTES, LOCATOR_BYTES) if tail_at + at >= LOCATOR_BYTES else b""
    if locator[:4] == LOCATOR:
        there = struct.unpack_from("<Q", locator, 8)[0]
        head = source.at(there, 56)
        if head[:4] != END64:
            raise ValueError("the ZIP64 locator leads nowhere")
        disk, first_disk, _, count, size, place = struct.unpack_from("<IIQQQQ", head, 16)
    if disk or first_disk:
        raise ValueError("a ZIP archive in several volumes")
    return count, size, place


def directory(source: Source) -> list[Member]:
    """The members of a ZIP archive, by its central directory."""
    count, size, place = _end(source)
    listing, at, out = source.at(place, size), 0, []
    for _ in range(count):
        if listing[at : at + 4] != ENTRY or at + ENTRY_BYTES > len(listing):
            raise ValueError("the central directory is cut off")
        flags, method = struct.unpack_from("<HH", listing, at + 8)
        stored_size, full_size, name_len, extra_len, comment_len = struct.unpack_from("<IIHHH", listing, at + 20)
        header = struct.unpack_from("<I", listing, at + 42)[0]
        name = listing[at + ENTRY_BYTES : at + ENTRY_BYTES + name_len]
        extra = listing[at + ENTRY_BYTES + name_len : at + ENTRY_BYTES + name_len + extra_len]
        wide = _wide(extra)
        # values that didn't fit stand in this order, and only those
        full_size = wide.pop(0) if full_size == FULL32 and wide else full_size
        stored_size = wide.pop(0) if stored_size == FULL32 and wide else stored_size
        header = wide.pop(0) if header == FULL32 and wide else header
        if flags & 1:
            raise ValueError(f"{name!r} is encrypted")
        out.append(Member(name.decode("utf-8" if flags & 0x800 else "cp437"), method, full_size, stored_size, header))
        at += ENTRY_BYTES + name_len + extra_len + comment_len
    return out


def _wide(extra: bytes) -> list[int]:
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            return list(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
        at += 4 + n
    return []


def _index_offsets(source: Source, members: list[Member]) -> dict[str, list[int]]:
    """Record offsets that the archive's CDXJ indexes name, by the last part of the WARC's name."""
    out: dict[str, list[int]] = {}
    for m in members:
        if not re.fullmatch(r"indexes/.*\.cdxj?(\.gz)?", m.name):
            continue
        data = source.at(m.start(source), m.stored_size)
        data = zlib.decompress(data, -15) if m.method == DEFLATED else data
        for line in (gzip.decompress(data) if m.name.endswith(".gz") else data).decode("utf-8").splitlines():
            told = line[line.find("{") :]
            if told.startswith("{") and not line.startswith("!"):
                entry = json.loads(told)
                out.setdefault(str(entry.get("filename", "")).rpartition("/")[2], []).append(int(entry["offset"]))
    return out


def ranges(uri: str, range_bytes: int = RANGE_BYTES) -> list[tuple[str, int, int, int, bool]]:
    """(archive, begin, end, member's begin, gzipped): each WARC member cut at record boundaries into ranges of about
    `range_bytes`; a member without an index is one range. Members that aren't stored raise an error."""
    source, out = Source(uri), []
    try:
        members = directory(source)
        offsets = _index_offsets(source, members)
        for m in members:
            if not re.fullmatch(r"(.*/)?[^/]+\.warc(\.gz)?", m.name):
                continue
            if m.method != STORED:
                raise ValueError(f"{m.name} is compressed by the archive; records can't be read by offset")
            base, cuts, last = m.start(source), [0], 0
            for at in sorted(offsets.get(m.name.rpartition("/")[2], [])):
                if at - last >= range_bytes and at < m.size:
                    cuts.append(at)
                    last = at
            cuts.append(m.size)
            out += [(uri, base + a, base + b, base, m.name.endswith(".gz")) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
    finally:
        source.close()
    return out


# --- records ----------------------------------------------------------------------------------------------------------


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(value: str) -> str:
    """A header's value: what would end the line or the header is percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(kind: str, record_id: str, date: str, block: bytes, **more: str | None) -> bytes:
    """A WARC record; `more` are header fields with _ for -, those that are None are left out."""
    fields = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": date}
    fields |= {k.replace("_", "-"): v for k, v in more.items() if v is not None}
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _fields(lines: list[bytes]) -> dict[str, str]:
    """Header fields by lower-case name; a line that starts with white space goes on with the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (b" ", b"\t") and name:
            out[name] += " " + line.strip().decode("utf-8", "replace")
        elif b":" in line:
            key, _, value = line.partition(b":")
            name = key.strip().decode("utf-8", "replace").lower()
            out[name] = value.strip().decode("utf-8", "replace")
    return out


class _Bytes:
    """A range's bytes as a stream: `get(n)` of the range, or of what its gzip members hold."""

    def __init__(self, source: Source, begin: int, end: int, gzipped: bool):
        self._source, self._at, self._end, self._gzipped = source, begin, end, gzipped
        self._raw, self._held = b"", bytearray()
        self._inflate = None
        self.begin = begin  # where in the archive the record begins that is read next

    def _more(self) -> bool:
        """One more piece of bytes; False at the end."""
        if not self._raw:
            self._raw = self._source.at(self._at, min(CHUNK, self._end - self._at))
            self._at += len(self._raw)
            if not self._raw:
                if self._inflate is not None:
                    raise ValueError("a gzip member is cut off")
                return False
        if not self._gzipped:
            self._held += self._raw
            self._raw = b""
            return True
        self._inflate = self._inflate or zlib.decompressobj(31)
        self._held += self._inflate.decompress(self._raw)
        self._raw = self._inflate.unused_data if self._inflate.eof else b""
        if self._inflate.eof:
            self._inflate = None
        return True

    def place(self) -> int:
        """Where in the archive what comes next begins: a gzip member, or, of plain bytes, they themselves."""
        return self._at - len(self._raw) - (0 if self._gzipped else len(self._held))

    def peek(self) -> bool:
        """Whether anything but line ends is left; takes those away."""
        while True:
            n = len(self._held) - len(self._held.lstrip(b"\r\n"))
            del self._held[:n]
            if self._held:
                return True
            if self._inflate is None:
                self.begin = self.place()
            if not self._more():
                return False

    def until(self, mark: bytes) -> bytes:
        at = self._held.find(mark)
        while at < 0:
            seen = max(0, len(self._held) - len(mark))
            if not self._more():
                raise ValueError("a record's header is cut off")
            at = self._held.find(mark, seen)
        out = bytes(self._held[:at])
        del self._held[: at + len(mark)]
        return out

    def get(self, n: int) -> bytes:
        while len(self._held) < n:
            if not self._more():
                raise ValueError("a record is cut off")
        out = bytes(self._held[:n])
        del self._held[:n]
        return out


def records(source: Source, begin: int, end: int, gzipped: bool) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of each record of a range. One record at a time is in memory."""
    stream = _Bytes(source, begin, end, gzipped)
    while stream.peek():
        offset = stream.begin if gzipped else stream.place()
        version, *lines = stream.until(b"\r\n\r\n").split(b"\r\n")
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {offset}")
        fields = _fields(lines)
        yield offset, fields, stream.get(int(fields["content-length"]))


def payload(fields: dict[str, str], block: bytes) -> tuple[bytes, dict[str, str]]:
    """A record's payload and its HTTP header fields; of records that aren't HTTP the block itself. Transfer encodings
    are left as they are."""
    if not fields.get("content-type", "").startswith("application/http"):
        return block, {}
    head, _, body = block.partition(b"\r\n\r\n")
    return body, _fields(head.split(b"\r\n")[1:])


# --- packages ---------------------------------------------------------------------------------------------------------


class _Package:
    """A package under way: records go straight to the store, the index is kept until the end."""

    def __init__(self, folder: str):
        name = uuid.uuid4().hex
        self.uri = f"{folder}/{name}.wacz"
        store, path = located(self.uri)
        self._warc, self._index, self.records, self.bytes = f"{name}.warc.gz", [], 0, 0
        self._sink = store.open_output_stream(path)
        self._zip = zipfile.ZipFile(self._sink, "w", zipfile.ZIP_STORED)
        self._member = self._zip.open(zipfile.ZipInfo(f"archive/{self._warc}"), "w", force_zip64=True)
        self._write(record("warcinfo", f"<urn:uuid:{uuid.UUID(name)}>", _now(), b"format: WARC file version 1.1\r\n", Content_Type="application/warc-fields"))

    def _write(self, data: bytes) -> tuple[int, int]:
        packed = zlib.compress(data, LEVEL, 31)
        at = self.bytes
        self._member.write(packed)
        self.bytes += len(packed)
        return at, len(packed)

    def add(self, data: bytes, url: str | None, date: str, digest: str) -> None:
        offset, length = self._write(data)
        told = {"url": url or "", "digest": f"sha1:{digest}", "length": length, "offset": offset, "filename": self._warc}
        self._index.append(f"{_line(url or '-')} {re.sub('[^0-9]', '', date)[:14]} {json.dumps(told)}\n")
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self._member.close()
        self._zip.writestr(zipfile.ZipInfo("indexes/index.cdxj"), "".join(sorted(self._index)))
        about = {"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": f"archive/{self._warc}", "bytes": self.bytes}]}
        self._zip.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps(about))
        self._zip.close()
        self._sink.close()
        return self.uri, self.records, self.bytes


def _now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def _written(folder: str, date: str, package_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for batch in batches:
            for rec_id, url, body, digest, refers in zip(*(batch.column(k) for k in range(5)), strict=True):
                rec_id, url, data, refers = rec_id.as_py(), url.as_py(), body.as_py(), refers.as_py()
                package = package or _Package(folder)
                name = base64.b32encode(bytes.fromhex(digest.as_py())).decode()
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(data)}\r\n\r\n".encode()
                about = {"WARC_Target_URI": None if url is None else _line(url), "WARC_Payload_Digest": f"sha1:{name}", "Content_Type": "application/http; msgtype=response"}
                if refers is None:
                    made = record("response", rec_id, date, http + data, **about)
                else:
                    made = record("revisit", rec_id, date, http, WARC_Refers_To=refers, WARC_Profile=PROFILE, **about)
                package.add(made, url, date, name)
                if package.bytes >= package_bytes:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        if done:
            yield pa.RecordBatch.from_pydict({n: pa.array(c) for n, c in zip(("archive", "records", "bytes"), zip(*done, strict=True), strict=True)})

    return run


def write_packages(rows: DataFrame, folder: str | None = None, least_revisit: int = 0, date: str | None = None, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write a record for each of `rows` (page_id, url, html) and return the table of packages: archive, records, bytes.

    The payload is html in UTF-8, empty if null. Of records with equal payloads (SHA-1) of at least `least_revisit`
    bytes, that with the largest page_id is a response and the others are revisits of it, without the payload; rows that
    share the largest page_id, null ids where all are null, are each a response. A null url gives a record without one;
    control characters and spaces of a url are percent-encoded. Other columns are ignored. An empty table writes nothing.
    Payloads aren't shuffled: only their digests are, and ids come back to rows as `with_totals` tells.
    """
    spark = rows.sparkSession
    folder = f"{folder or shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    store, path = located(folder)
    store.create_dir(path, recursive=True)
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    pages = rows.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    pages = pages.withColumn("digest", F.sha1("payload"))
    long_enough = F.octet_length("payload") >= least_revisit
    shared = pages.where(long_enough).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("kept")).where("n > 1")
    n_rows = pages.where(long_enough).select("page_id").count()
    pages = with_totals(pages, shared, "digest", n_rows)
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    revisits = long_enough & F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    out = pages.select(name("page_id").alias("record_id"), "url", "payload", "digest", F.when(revisits, name("kept")).alias("refers_to"))
    bounded_batches(spark)
    return stash(out.mapInArrow(_written(folder, date or _now(), package_bytes), PACKAGES), "packages")[0]


def read_packages(packages: DataFrame, payloads: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of all packages that `packages` (column archive) names: RECORDS, and `payload` unless not wanted.

    Any ZIP archive with stored WARC members will do. payload_bytes and payload_digest are those of the payload as read,
    but for revisits those that the record tells; digest_ok is whether the record's own digest agrees (null if it has
    none). warcinfo and other records are rows too. A damaged archive, or a WARC that the archive compresses, raises.
    """
    spark = packages.sparkSession
    cores = max(spark.sparkContext.defaultParallelism, 1)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                if found := ranges(uri, range_bytes):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], ["archive", "begin", "end", "base", "gzipped"])

    names = packages.select("archive").where(F.col("archive").isNotNull()).repartition(4 * cores)
    cut, _ = stash(names.mapInArrow(listed, "archive string, begin long, end long, base long, gzipped boolean"), "ranges")
    total = cut.agg(F.sum(F.col("end") - F.col("begin"))).first()[0] or 0
    cut = cut.repartition(max(2 * cores, -(-total // TASK_BYTES)))
    schema = RECORDS + (", payload binary" if payloads else "")
    names = [f.split()[0] for f in re.split(r", (?!string>)", schema.replace("map<string,string>", "map"))]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, begin, end, base, gzipped in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                source, rows, held = Source(uri), [], 0
                try:
                    for offset, fields, block in records(source, begin, end, gzipped):
                        rows.append(_row(uri, offset - base, fields, block, payloads))
                        held += len(rows[-1][-1] or b"") if payloads else 64
                        if held >= RANGE_BYTES or len(rows) >= 4096:
                            yield _batch(names, rows)
                            rows, held = [], 0
                finally:
                    source.close()
                if rows:
                    yield _batch(names, rows)

    return cut.mapInArrow(read, schema)


def _row(uri: str, offset: int, fields: dict[str, str], block: bytes, payloads: bool) -> tuple:
    body, http = payload(fields, block)
    told = fields.get("warc-payload-digest")
    told = told.removeprefix("sha1:").upper() if told and told.lower().startswith("sha1:") else told
    if fields.get("warc-type") == "revisit":
        n = http.get("content-length")
        seen = (int(n) if n and n.isdigit() else None, told, None)
    else:
        digest = base32_sha1(body)
        seen = (len(body), digest, None if told is None else told == digest)
    row = (uri, offset, fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-refers-to"), fields.get("warc-target-uri"), fields.get("warc-date"), *seen, list(fields.items()))
    return (*row, body) if payloads else row


def _batch(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"offset": pa.int64(), "payload_bytes": pa.int64(), "digest_ok": pa.bool_(), "headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)


def page_records(packages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of what `write_packages` wrote, read back."""
    read = read_packages(packages, payloads=False).where(F.col("record_type").isin("response", "revisit"))
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    checked = F.when(F.col("digest_ok") == F.lit(False), F.raise_error(F.concat(F.lit("payload differs from its digest: "), "record_id"))).otherwise(F.col("payload_digest"))
    return read.select(number("record_id").alias("page_id"), "payload_bytes", checked.alias("payload_digest"), "record_type", number("refers_to_id").alias("refers_to"))
