import gzip
import hashlib
import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from weftline.llm import warc, zips

LONG = "<p>" + "text " * 40


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(5, "http://a/5", LONG), (2, "http://a/2 b\r\nX: y", LONG), (9, None, LONG), (2, "http://a/2", LONG), (None, "u", LONG), (3, "http://a/3", None), (4, "http://a/4", ""), (6, "http://a/6", "short"), (7, "http://a/7", "short"), (8, "http://ü/8", "Ä" * 50), (10, "x", "\r\n\r\nWARC/1.1\r\n" * 9)]
    return spark.createDataFrame([(u, h, i, "k", 1) for i, u, h in rows], "url string, html string, page_id long, record_type string, payload long").repartition(3)


def test_round_trip(spark, pages):
    got = {}
    for r in warc.report(pages).collect():
        got.setdefault(r["page_id"], []).append((r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["verified"]))
    told = lambda t: (len((t or "").encode()), hashlib.sha256((t or "").encode()).hexdigest())
    first, again = (*told(LONG), "response", None, True), (*told(LONG), "revisit", 2, True)
    assert got.pop(2) == [first, first] and got.pop(5) == got.pop(9) == got.pop(None) == [again]
    plain = {3: None, 4: "", 6: "short", 7: "short", 8: "Ä" * 50, 10: "\r\n\r\nWARC/1.1\r\n" * 9}
    assert got == {i: [(*told(t), "response", None, True)] for i, t in plain.items()}
    assert warc.report(pages.where("false")).count() == 0
    assert [r["refers_to"] for r in warc.report(pages.where("page_id is null or page_id = 6")).collect()] == [None, None]


def test_packages_are_plain_zip_files(spark, pages, tmp_path):
    told = warc.write_packages(warc.with_revisits(pages), str(tmp_path / "p"), full=1).collect()  # each record fills a package
    assert len(told) == 11 and sum(r["records"] for r in told) == 11
    assert sorted(os.listdir(tmp_path / "p")) == sorted(os.path.basename(r["path"]) for r in told)
    one = next(r["path"].removeprefix("file:") for r in told)
    with zipfile.ZipFile(one) as z:
        assert z.testzip() is None and z.namelist() == [warc.ARCHIVE, warc.INDEX, warc.ABOUT]
        data = z.read(warc.ARCHIVE)
        line = json.loads(z.read(warc.INDEX).split(b" ", 2)[2])
        assert line["length"] == len(data) and json.loads(z.read(warc.ABOUT))["resources"][0]["hash"] == "sha256:" + hashlib.sha256(data).hexdigest()
    assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: re")
    back = warc.records(spark, str(tmp_path / "p"))
    assert back.count() == 11 and back.where("uri = 'http://a/2%20b%0D%0AX:%20y'").count() == 1
    assert {bytes(r["payload"]) for r in back.where("record_type = 'response' and stated_bytes = 100").collect()} == {("Ä" * 50).encode()}
    members = warc.contents(warc.packages(spark, str(tmp_path / "p"))).groupBy("member").count().collect()
    assert {r["member"]: r["count"] for r in members} == {warc.ARCHIVE: 11, warc.INDEX: 11, warc.ABOUT: 11}


def record(i, block):
    return f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:{i}>\r\nContent-Type: text/plain\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("wide", [False, True])
def test_packages_of_others(spark, tmp_path, monkeypatch, wide):
    """Archives without an index, packed or not, behind other bytes, with a comment, and ZIP64 directories."""
    if wide:
        for name in ("ZIP64_LIMIT", "ZIP_FILECOUNT_LIMIT"):
            monkeypatch.setattr(zipfile, name, 1)
    out = io.BytesIO()
    out.write(b"in front")
    records = [record(i, os.urandom(70 * i)) for i in range(30)]
    with zipfile.ZipFile(out, "a" if not wide else "w", zipfile.ZIP_STORED) as z:
        z.comment = b"PK\5\6 a comment that looks like an end" + b"." * 30
        z.mkdir("archive")
        z.writestr("archive/plain.warc", b"".join(records[:10]))
        z.writestr("archive/packed.warc.gz", b"".join(map(gzip.compress, records[10:20])))
        indexed = list(map(gzip.compress, records[20:]))
        z.writestr("archive/indexed.warc.gz", b"".join(indexed))
        places = [(sum(map(len, indexed[:i])), len(x)) for i, x in enumerate(indexed)]
        lines = [f'org,x)/{i} 2020 {json.dumps({"offset": str(o), "length": str(n), "filename": "indexed.warc.gz"})}\n' for i, (o, n) in enumerate(places)]
        z.writestr("indexes/index.cdx.gz", gzip.compress(b"!meta {}\n" + "".join(reversed(lines[:8])).encode()))
        z.writestr("archive/squeezed.warc", b"".join(records), zipfile.ZIP_DEFLATED)
    (tmp_path / "x.wacz").write_bytes(out.getvalue())
    got = {r["record_id"]: bytes(r["payload"]) for r in warc.records(spark, str(tmp_path)).collect()}
    want = {f"urn:x:{i}": r.split(b"\r\n\r\n", 1)[1][:-4] for i, r in enumerate(records[:28])}  # two have no line in the index
    assert got == want
    listed = {r["member"]: r["stored"] for r in warc.contents(warc.packages(spark, str(tmp_path))).collect()}
    assert listed["archive/squeezed.warc"] is False and listed["archive/plain.warc"] is True
    (tmp_path / "bad.wacz").write_bytes(b"no package")
    with pytest.raises(Exception, match="not a ZIP package"):
        warc.records(spark, str(tmp_path)).count()


def test_directories_of_large_packages(tmp_path):
    """Sizes and offsets beyond 4 GB, in a sparse file."""
    path, far = tmp_path / "large.zip", 5 << 30
    with path.open("wb") as f:
        held = []
        package = zips.Package(lambda data: held.append(data))
        package.begin("a.warc")
        f.write(b"".join(held))
        start = f.tell()
        held.clear()
        package.members[-1][3] = far  # so many zeros, left out of the file
        package.written += far
        f.seek(start + far)
        package.end()
        package.begin("b.warc")
        package.write(b"hello")
        package.end()
        package.close()
        f.write(b"".join(held))
    with path.open("rb") as f:

        def read(at, n):
            f.seek(at)
            return f.read(n)

        a, b = zips.members(read, path.stat().st_size)
        assert (a.start, a.size, b.size) == (start, far, 5) and read(b.start, 5) == b"hello"
    with zipfile.ZipFile(path) as z:
        assert [x.file_size for x in z.infolist()] == [far, 5] and z.read("b.warc") == b"hello"


def test_long_payloads_and_folders_without_packages(spark, tmp_path):
    big = spark.range(3).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.lit("0123456789abcdef"), 600_000).alias("html"))
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"], r["verified"]) for r in warc.report(big).collect()}
    assert got == {0: (9_600_000, "response", None, True), 1: (9_600_000, "revisit", 0, True), 2: (9_600_000, "revisit", 0, True)}
    (tmp_path / "none").mkdir()
    assert warc.records(spark, str(tmp_path / "none")).count() == 0
