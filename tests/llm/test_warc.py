"""ZIP packages of WARC records: round trips, ZIP64, damaged and foreign archives, odd rows."""

import base64
import gzip
import hashlib
import io
import json
import struct
import zipfile

import duckdb
import pytest

from casegraph.llm import warc
from casegraph.llm import queries as Q

SCHEMA = "page_id long, url string, html string, digest string, n long, kept long, payload string"
BIG = "<p>é𝄞</p>" * 60_000
ROWS = [
    (1, "http://a.example/1", "<p>one</p>"), (2, "http://a.example/2", "<p>one</p>"), (3, None, "<p>one</p>"), (4, "http://a.example/4", None), (5, "u", ""), (6, "u", BIG), (6, "u", BIG),
    (7, "http://x/\r\nWARC-Type: warcinfo", "WARC/1.1\r\n\r\n"), (None, "n", "<p>null id</p>"), (None, "n", "<p>one</p>"), (9, "u", "\r\n\r\nHTTP/1.1\r\n"), (-8, "u", BIG), (10, "", " \n"),
]


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, 2, "p") for r in rows], SCHEMA)


def _digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def by_hand(rows, least=0):
    out = []
    for i, _, h in rows:
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        kept = max(same, default=None)
        revisit = len((h or "").encode()) >= least and i != kept
        out.append((i, len((h or "").encode()), _digest(h), "revisit" if revisit else "response", kept if revisit else None))
    return sorted(out, key=str)


def _got(df):
    return sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in df.collect()), key=str)


@pytest.mark.parametrize("least", [0, 20])
def test_round_trip(spark, least):
    pages = _frame(spark, ROWS).repartition(3)
    packages = warc.write_packages(pages, least_revisit=least)
    assert _got(warc.page_records(packages)) == by_hand(ROWS, least)
    read = warc.read_packages(packages, range_bytes=64).where("record_type = 'response'").collect()
    assert {bytes(r["payload"]) for r in read} == {(h or "").encode() for _, _, h in ROWS}
    assert {r["target_uri"] for r in read} >= {"http://x/%0D%0AWARC-Type:%20warcinfo"} and all(r["digest_ok"] for r in read)


def test_many_small_packages(spark):
    packages = warc.write_packages(_frame(spark, ROWS).coalesce(1), package_bytes=1)
    assert packages.count() == len(ROWS) and _got(warc.page_records(packages)) == by_hand(ROWS)


def test_empty(spark):
    assert warc.page_records(warc.write_packages(_frame(spark, []))).collect() == []


def test_as_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    want = con.sql(Q.oracle_sql()["op13_warc"])
    got = Q.queries()["op13_warc"](spark, sf_dir)
    assert sorted(map(str, (tuple(r[c] for c in want.columns) for r in got.collect()))) == sorted(map(str, want.fetchall()))


def test_packages_are_zip_archives_with_stored_warcs(spark):
    packages = warc.write_packages(_frame(spark, ROWS).coalesce(1)).collect()
    with zipfile.ZipFile(packages[0]["archive"].removeprefix("file://")) as z:
        names = z.namelist()
        inner = next(n for n in names if n.endswith(".warc.gz"))
        assert z.testzip() is None and z.getinfo(inner).compress_type == zipfile.ZIP_STORED and "datapackage.json" in names
        data = z.read(inner)
        for line in z.read("indexes/index.cdxj").decode().splitlines():
            at = json.loads(line[line.index("{") :])
            assert gzip.decompress(data[at["offset"] : at["offset"] + at["length"]]).startswith(b"WARC/1.1\r\n")
    assert packages[0]["records"] == len(ROWS)


def _foreign(gzipped=True, index=True, compressed=False, comment=b""):
    """An archive by other hands: a request beside each response, folded headers, an index that names some records."""
    blocks, lines, at = [], [], 0
    for k in range(30):
        http = f"HTTP/1.0 200 OK\r\nX: y\r\n\r\nbody {k}".encode()
        one = f"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:r:{k}>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Type: application/http;\r\n msgtype=response\r\nContent-Length: {len(http)}\r\n\r\n".encode() + http + b"\r\n\r\n"
        two = f"WARC/1.0\r\nWARC-Type: request\r\nWARC-Record-ID: <urn:q:{k}>\r\nContent-Length: 3\r\n\r\nGET\r\n\r\n".encode()
        for n, r in enumerate((one, two)):
            raw = gzip.compress(r) if gzipped else r
            if n == 0 and k % 2 == 0:
                lines.append(f"key {k} " + json.dumps({"offset": str(at), "filename": "x/y.warc.gz" if gzipped else "x/y.warc"}))
            blocks.append(raw)
            at += len(raw)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = comment
        z.writestr("readme.txt", "no WARC")
        z.writestr("archive/y.warc.gz" if gzipped else "archive/y.warc", b"".join(blocks), zipfile.ZIP_DEFLATED if compressed else zipfile.ZIP_STORED)
        if index:
            z.writestr("indexes/index.cdx.gz", gzip.compress("\n".join(["!meta {}", *lines]).encode()), zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _read(spark, tmp_path, data, **more):
    path = tmp_path / "some.zip"
    path.write_bytes(data)
    return warc.read_packages(spark.createDataFrame([(str(path),)], "archive string"), **more).collect()


@pytest.mark.parametrize("shape", [{}, {"gzipped": False}, {"index": False}, {"gzipped": False, "index": False}, {"comment": b"PK\x05\x06 in a comment, " + b"x" * 40_000}])
def test_foreign_archives(spark, tmp_path, shape):
    rows = _read(spark, tmp_path, _foreign(**shape), range_bytes=200)
    assert sorted(r["record_id"] for r in rows) == sorted(f"<urn:{c}:{k}>" for c in "rq" for k in range(30))
    assert {bytes(r["payload"]) for r in rows if r["record_type"] == "response"} == {f"body {k}".encode() for k in range(30)}
    assert all(r["digest_ok"] is None for r in rows) and len({r["offset"] for r in rows}) == 60


def test_zip64(spark, tmp_path, monkeypatch):
    """The same archive with every size, place and number in the ZIP64 form."""
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    data = _foreign()
    assert warc.LOCATOR in data and warc.END64 in data
    (tmp_path / "a.zip").write_bytes(data)
    members = warc.directory(warc.Source(str(tmp_path / "a.zip")))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert [(m.name, m.size, m.header) for m in members] == [(i.filename, i.file_size, i.header_offset) for i in z.infolist()]
    assert len(_read(spark, tmp_path, data, range_bytes=200)) == 60


@pytest.mark.parametrize("shape", ["compressed", "no zip", "cut off", "encrypted", "volumes"])
def test_damaged_archives_raise(tmp_path, shape):
    data = bytearray(_foreign(compressed=shape == "compressed"))
    if shape == "no zip":
        data = bytearray(b"x" * 500)
    elif shape == "cut off":
        data = data[: len(data) // 2]
    elif shape == "encrypted":
        data[data.rindex(warc.ENTRY) + 8] |= 1
    elif shape == "volumes":
        struct.pack_into("<H", data, data.rindex(warc.END) + 4, 1)
    (tmp_path / "b.zip").write_bytes(bytes(data))
    with pytest.raises(ValueError):
        warc.ranges(str(tmp_path / "b.zip"))


def test_cut_off_records_raise(tmp_path):
    whole = gzip.compress(warc.record("response", "<urn:x>", "2020-01-01T00:00:00Z", b"abc" * 100))
    (tmp_path / "c").write_bytes(whole[:-30])
    with pytest.raises(ValueError):
        list(warc.records(warc.Source(str(tmp_path / "c")), 0, len(whole) - 30, True))
