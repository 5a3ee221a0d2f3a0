"""WARC records in ZIP packages: written by tasks, and read by range without extraction.

A package holds, stored and not packed, ``archive/data.warc.gz`` - a gzip member for each record -,
``indexes/index.cdxj`` with the place of each, and ``datapackage.json``.  Reading has three steps: the
packages' directories, central and ZIP64, give the place of stored archives and indexes; indexes give
the places of records, cut into spans of about ``SPAN`` bytes; and tasks read spans by range.  An archive
without an index is one span and is read as a stream; members that are packed are listed by ``contents``
and not read.

Of records with equal payloads of ``least`` bytes or more, those of the smallest page_id are responses and
the others revisits, which refer to it and hold no payload.

Odd rows: a null html is an empty payload; a null page_id is the id ``none`` and counts behind all others,
so such rows are responses if none of their group has an id; rows that repeat the smallest page_id of their
group are responses too.  White space and control signs in a URL are percent-encoded, and a null one is left
out.  No rows make no packages, and a folder without packages has no records.  A file that is no package, or
a record that breaks off, fails the job.  Other columns do not matter.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import zips
from weftline.llm._spark import arrow_batches, scratch, written
from weftline.stores import Upload, input_file, make_folder, qualified

ARCHIVE, INDEX, ABOUT, SUFFIX = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json", ".wacz"
#: Bytes of a span, the bytes between records that are read with them, and the bytes at which a package is full.
SPAN, GAP, FULL = 8 << 20, 64 << 10, 256 << 20
SPANS_A_TASK = 8
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KEY = "urn:weftline:page:"

PACKAGES = "path string, records long, bytes long"
SPANS = "path string, packed boolean, starts array<long>, sizes array<long>"
RECORDS = "path string, offset long, record_id string, record_type string, uri string, refers_to string, stated_digest string, status int, mime string, stated_bytes long, payload binary"


def with_revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, refers_to): the html of pages, and for revisits whose payload theirs is."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    first = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = rows.join(written(first), "payload_digest", "left")  # only digests that repeat, so that other rows need not move
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return met.select("page_id", "url", "payload", "payload_bytes", "payload_digest", refers.alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record: a response, or a revisit with the header of the response alone."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{KEY}{'none' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f-\xa0  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: <{KEY}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Writer:
    """The package that a task is writing."""

    def __init__(self, path: str, level: int, date: str):
        self.path, self.level, self.date = path, level, date
        self.file = Upload(path)
        self.zip = zips.Package(self.file.write)
        self.zip.begin(ARCHIVE)
        self.index, self.sum = [], hashlib.sha256()

    def add(self, row: tuple) -> None:
        page_id, url, payload, size, digest, refers_to = row
        packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        data = packer.compress(record(page_id, url, payload, size, digest, refers_to, self.date)) + packer.flush()
        self.sum.update(data)
        own = {"url": url, "mime": "warc/revisit" if refers_to is not None else "text/html", "status": "200", "digest": f"sha256:{digest}", "length": len(data), "offset": self.zip.write(data), "filename": ARCHIVE.rsplit("/", 1)[1]}
        self.index.append(json.dumps(own, separators=(",", ":")))

    def close(self) -> tuple[str, int, int]:
        self.zip.end()
        stamp = re.sub(r"\D", "", self.date)[:14]
        about = [{"name": ARCHIVE.rsplit("/", 1)[1], "path": ARCHIVE, "hash": f"sha256:{self.sum.hexdigest()}", "bytes": self.zip.members[0][3]}]
        self.zip.begin(INDEX)
        for x in self.index:
            self.zip.write(f"- {stamp} {x}\n".encode())
        self.zip.end()
        self.zip.begin(ABOUT)
        self.zip.write(json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": about}).encode())
        self.zip.end()
        self.zip.close()
        self.file.close()
        return self.path, len(self.index), self.file.size


def write_packages(rows: DataFrame, folder: str, level: int = 4, date: str = "2020-01-01T00:00:00Z", full: int = FULL) -> DataFrame:
    """Writes what ``with_revisits`` gives as packages into a folder that all tasks share; (path, records, bytes) of each.

    A package is named by its task's number, appears when it is whole, and is written again in its place if its task is run again.
    """
    spark = rows.sparkSession
    arrow_batches(spark)
    folder = qualified(spark, folder).rstrip("/")
    make_folder(spark, folder)

    def run(batches):
        task, own, done = TaskContext.get(), None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to")), strict=True):
                if own is None:
                    own = _Writer(f"{folder}/pages-{task.partitionId():06d}-{len(done):04d}{SUFFIX}", level, date)
                own.add(row)
                if own.file.size >= full:
                    done.append(own.close())
                    own = None
        if own:
            done.append(own.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["path", "records", "bytes"])

    return written(rows.mapInArrow(run, PACKAGES))


class _Range(io.RawIOBase):
    """A part of a file, read in order."""

    def __init__(self, file, start: int, size: int):
        self.file, self.at, self.end = file, start, start + size

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self.file.read_at(min(len(into), self.end - self.at), self.at) if self.at < self.end else b""
        into[: len(data)] = data
        self.at += len(data)
        return len(data)


def packages(spark: SparkSession, folder: str, pattern: str = f"*{SUFFIX}") -> DataFrame:
    """(path, length) of the packages in a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length")


def contents(found: DataFrame) -> DataFrame:
    """(path, member, stored, start, size) of all members of packages, from their directories."""

    def run(batches):
        for batch in batches:
            for path, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with input_file(path) as file:
                    rows = [(path, m.name, m.stored, m.start, m.size) for m in _members(file, path, length)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["path", "member", "stored", "start", "size"])

    return found.mapInArrow(run, "path string, member string, stored boolean, start long, size long")


def _members(file, path: str, length: int) -> Iterator[zips.Member]:
    try:
        yield from zips.members(lambda at, n: file.read_at(n, at), length)
    except ValueError as e:
        raise ValueError(f"{path}: {e}") from e


def _indexed(file, member: zips.Member) -> Iterator[tuple[str, int, int]]:
    """(file name, offset, length) of the lines of an index."""
    raw = io.BufferedReader(_Range(file, member.start, member.size), 1 << 20)
    for line in gzip.GzipFile(fileobj=raw) if member.name.endswith(".gz") else raw:
        at = line.find(b"{")
        if at >= 0 and not line.startswith(b"!"):
            own = json.loads(line[at:])
            yield own["filename"], int(own["offset"]), int(own["length"])


def spans(found: DataFrame) -> DataFrame:
    """(path, packed, starts, sizes): the places of neighbouring records in a package, or of a whole archive that has no index (sizes negative)."""

    def cut(path: str, packed: bool, places: list[tuple[int, int]]):
        own: list[tuple[int, int]] = []
        for start, size in [*sorted(places), (None, 0)]:
            if own and (start is None or start - sum(own[-1]) > GAP or start + size - own[0][0] > SPAN):
                yield path, packed, [s for s, _ in own], [n for _, n in own]
                own = []
            if start is not None:
                own.append((start, size))

    def run(batches):
        for batch in batches:
            for path, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with input_file(path) as file:
                    all_ = [m for m in _members(file, path, length) if m.stored]
                    archives = {m.name.rsplit("/", 1)[-1]: m for m in all_ if re.search(r"\.warc(\.gz)?$", m.name)}
                    places: dict[str, list[tuple[int, int]]] = {}
                    for m in all_:
                        if re.search(r"\.cdxj?(\.gz)?$", m.name):
                            for name, offset, size in _indexed(file, m):
                                held = archives.get(name.rsplit("/", 1)[-1])
                                if held is None or offset + size > held.size:
                                    raise ValueError(f"{path}: the index names {name} at {offset}, which is not there")
                                places.setdefault(held.name, []).append((held.start + offset, size))
                rows = []
                for m in archives.values():
                    packed = m.name.endswith(".gz")
                    rows += cut(path, packed, places[m.name]) if m.name in places else [(path, packed, [m.start], [-m.size])]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["path", "packed", "starts", "sizes"])

    return found.mapInArrow(run, SPANS)


def _record(data) -> tuple | None:
    """The next record of a binary stream as in RECORDS, without path and offset; None at its end."""
    line = data.readline()
    while line in (b"\r\n", b"\n"):
        line = data.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    head = _fields(data)
    size = int(head["content-length"])
    block = data.read(size)
    if len(block) < size:
        raise ValueError("a record breaks off")
    status = mime = stated = None
    payload = block
    if head.get("content-type", "").startswith("application/http"):
        first, _, rest = block.partition(b"\r\n")
        inner = io.BytesIO(rest)
        http = _fields(inner)
        payload = rest[inner.tell() :]
        status = int(m[1]) if (m := re.match(rb"HTTP/\S+ (\d+)", first)) else None
        mime, stated = http.get("content-type"), int(http["content-length"]) if http.get("content-length", "").isdigit() else None
    name = lambda k: head[k].strip("<>") if k in head else None
    return name("warc-record-id"), head.get("warc-type"), head.get("warc-target-uri"), name("warc-refers-to"), head.get("warc-payload-digest"), status, mime, stated, payload


def _fields(data) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in iter(data.readline, b""):
        if line in (b"\r\n", b"\n"):
            break
        key, _, value = line.decode("utf-8", "replace").partition(":")
        out.setdefault(key.strip().lower(), value.strip())
    return out


def _read(batches):
    """The records of spans, in batches of about SPAN bytes."""
    rows, size = [], 0

    def out():
        columns = list(zip(*rows, strict=True))
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int32(), pa.string(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in RECORDS.split(", ")])

    for batch in batches:
        for path, packed, starts, sizes in zip(*(batch.column(c).to_pylist() for c in ("path", "packed", "starts", "sizes")), strict=True):
            with input_file(path) as file:
                for found in _whole(file, packed, starts[0], -sizes[0]) if sizes[0] < 0 else _placed(file, packed, starts, sizes):
                    rows.append((path, *found))
                    size += len(found[-1])
                    if size >= SPAN or len(rows) >= 10_000:
                        yield out()
                        rows, size = [], 0
    if rows:
        yield out()


def _placed(file, packed: bool, starts: list[int], sizes: list[int]):
    held = file.read_at(max(s + n for s, n in zip(starts, sizes, strict=True)) - starts[0], starts[0])
    for s, n in zip(starts, sizes, strict=True):
        data = held[s - starts[0] : s - starts[0] + n]
        yield s, *_record(io.BytesIO(gzip.decompress(data) if packed else data))


def _whole(file, packed: bool, start: int, size: int):
    raw = io.BufferedReader(_Range(file, start, size), 1 << 20)
    data = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if packed else raw
    n = 0
    while (found := _record(data)) is not None:
        yield n, *found  # its number, as a stream has no places
        n += 1


def records(spark: SparkSession, folder: str, pattern: str = f"*{SUFFIX}") -> DataFrame:
    """The records in the packages of a folder, each read by range; see RECORDS."""
    arrow_batches(spark)
    found = packages(spark, folder, pattern)
    cut = written(spans(found.repartition(max(1, spark.sparkContext.defaultParallelism), "path")))
    tasks = max(1, min(n := cut.count(), max(spark.sparkContext.defaultParallelism, n // SPANS_A_TASK)))  # a fixed number: spans are small rows and long work
    return cut.repartition(tasks, "path", F.col("starts")[0]).mapInArrow(_read, RECORDS)


def report(pages: DataFrame, least: int = 100) -> DataFrame:
    """A row a page, as read back from packages written to the shared folder; revisits have the figures of the response read back."""
    spark = pages.sparkSession
    folder = scratch(spark)
    write_packages(with_revisits(pages, least), folder)
    key = lambda c: F.expr(f"try_cast(substring({c}, {len(KEY) + 1}) as long)")
    back = records(spark, folder)
    back = back.select(key("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", key("refers_to").alias("refers_to"), "stated_digest", "uri")
    back = written(back)
    wanted = back.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id")).distinct()
    own = back.where("record_type = 'response'").join(wanted, "page_id", "left_semi").groupBy(F.col("page_id").alias("refers_to")).agg(F.max("payload_bytes").alias("b"), F.max("payload_digest").alias("d"))
    met = back.join(written(own), "refers_to", "left")
    same = F.col("stated_digest") == F.concat(F.lit("sha256:"), F.when(F.col("record_type") == "revisit", F.col("d")).otherwise(F.col("payload_digest")))
    revisit = F.col("record_type") == "revisit"
    return met.select("page_id", F.when(revisit, F.col("b")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), F.when(revisit, F.col("d")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to", same.alias("verified"), "uri")
