"""WARC records in ZIP packages: written by parallel tasks, read back by byte ranges without extraction.

A package holds ``archive/pages.warc.gz`` (every record a gzip member of its own), ``indexes/index.cdx`` with the place of
each record, and ``datapackage.json``; all members are stored, so a record's place in the package is its place in the
member plus the member's. Each writing task makes packages of bounded size under names of its own and reports them; the
table of reports is the only list that readers trust, so what a lost attempt left behind is never read. Reading first
parses the directories and indexes, one row per package, into ranges of records; the ranges are dealt out to tasks.

A payload that occurs several times is written once. Which record that is follows from narrow rows (id, digest); payloads
are shuffled once, by row and not by payload, so thousands of copies of a page do not meet in one task.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from peakloom.llm.zip_archives import Member, ZipReader, open_store
from peakloom.session import cut_lineage, scratch_path

#: Shorter payloads are written out each time.
MIN_SHARED = 1000
#: Bytes of records in one package, and in one range that is read at once; a longer record is a range of its own.
PACKAGE_BYTES = 256 << 20
RANGE_BYTES = 8 << 20
#: Bytes handed to a gzip opener at once: about a record.
PIECE_BYTES = 4 << 10
SALTS = 16
DATE = "1970-01-01T00:00:00Z"
MEMBER, INDEX = "archive/pages.warc.gz", "indexes/index.cdx"

REPORT = T.StructType([T.StructField("archive", T.StringType()), T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType())])
RANGE = T.StructType([
    T.StructField("archive", T.StringType()), T.StructField("member", T.StringType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())
])


def _lines(first: str, fields: dict[str, str | int | None]) -> bytes:
    """A header block; values may not break lines."""
    return "\r\n".join([first, *[f"{k}: {v}" for k, v in fields.items() if v is not None], "", ""]).encode()


def record_id(page: str | None) -> str:
    return f"<urn:page:{quote(page or '', safe='')}>"


def warc_record(page: str | None, url: str | None, payload: bytes, refers_to: str | None, date: str = DATE) -> bytes:
    """A response record, or a revisit of the page ``refers_to`` whose payload is left out."""
    target = None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")
    http = _lines("HTTP/1.1 200 OK", {"Content-Type": "text/html; charset=utf-8", "Content-Length": len(payload)})
    block = http if refers_to is not None else http + payload
    head = _lines("WARC/1.1", {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page),
        "WARC-Date": date,
        "WARC-Target-URI": target,
        "WARC-Profile": None if refers_to is None else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        "WARC-Refers-To": None if refers_to is None else record_id(refers_to),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode(),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    })
    return head + block + b"\r\n\r\n"


class PackageWriter:
    """One package, written from front to end; records go straight to the file, only the index waits for the end."""

    def __init__(self, uri: str) -> None:
        system, path = open_store(uri)
        self.uri, self.out = uri, system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(MEMBER), "w", force_zip64=True)
        self.digest, self.size, self.index = hashlib.sha256(), 0, []

    def add(self, key: str, record: bytes) -> None:
        packer = zlib.compressobj(5, zlib.DEFLATED, 31)
        data = packer.compress(record) + packer.flush()
        self.member.write(data)
        self.digest.update(data)
        place = {"offset": self.size, "length": len(data), "filename": MEMBER.rsplit("/", 1)[1]}
        self.index.append(f"{key} {DATE} {json.dumps(place)}\n")
        self.size += len(data)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        index = "".join(sorted(self.index)).encode()
        parts = [(MEMBER, self.digest.hexdigest(), self.size), (INDEX, hashlib.sha256(index).hexdigest(), len(index))]
        described = [{"name": p.rsplit("/", 1)[1], "path": p, "hash": f"sha256:{h}", "bytes": n} for p, h, n in parts]
        self.zip.writestr(zipfile.ZipInfo(INDEX), index)
        self.zip.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps({"profile": "data-package", "resources": described}))
        self.zip.close()
        self.out.close()
        return self.uri, len(self.index), self.size


def shared_payloads(pages: DataFrame, id_column: str, min_shared: int = MIN_SHARED) -> DataFrame:
    """(id, digest, refers_to) of the records whose payload a record with a larger id has too."""
    narrow = pages.filter(F.octet_length("_payload") >= min_shared).select(id_column, "_digest").distinct()
    groups = narrow.groupBy("_digest").agg(F.max(id_column).alias("refers_to"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    # a payload that very many rows share is looked up by many tasks
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).drop("_n")
    salt = F.pmod(F.xxhash64(id_column), F.lit(SALTS)).cast("int")
    found = narrow.withColumn("_salt", salt).join(salted, ["_digest", "_salt"])
    return found.filter(F.col(id_column).isNull() | (F.col(id_column) < F.col("refers_to"))).select(id_column, "_digest", "refers_to")


def write_packages(
    df: DataFrame, folder: str | None = None, id_column: str = "page_id", url: str = "url", html: str = "html",
    min_shared: int = MIN_SHARED, package_bytes: int = PACKAGE_BYTES,
) -> DataFrame:
    """Write a record per row into packages in ``folder`` (a new one in the shared folder if not given) and return their
    list: archive, records, bytes.

    Of rows with equal payloads of at least ``min_shared`` bytes, the one with the largest id is a response and the others
    revisit it; rows that share this id are all responses. Null html is an empty payload; a null url is left out; a null id
    counts as smaller than any other, and rows of a payload that has no other id are responses. An empty table writes
    nothing; other columns are ignored.
    """
    spark = df.sparkSession
    folder = qualified(spark, folder or scratch_path(spark))
    system, path = open_store(folder)
    system.create_dir(path)
    payload = F.encode(F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")), "UTF-8")
    rows = df.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{url}`").cast("string").alias("_url"), payload.alias("_payload"))
    rows = rows.withColumn("_digest", F.unhex(F.sha2("_payload", 256)))
    shared = shared_payloads(rows, "_id", min_shared).withColumnRenamed("_id", "_own").withColumnRenamed("_digest", "_same")
    joined = rows.join(shared, F.col("_id").eqNullSafe(F.col("_own")) & (F.col("_digest") == F.col("_same")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, reports = None, []
        for batch in batches:
            names = [batch.column(c).to_pylist() for c in ("_id", "_url", "_target")]
            for page, link, target, data in zip(*names, batch.column("_payload")):
                writer = writer or PackageWriter(f"{folder}/pages-{uuid.uuid4().hex}.wacz")
                writer.add(quote(page or "", safe=""), warc_record(page, link, data.as_py(), target))
                if writer.size >= package_bytes:
                    reports.append(writer.close())
                    writer = None
        if writer:
            reports.append(writer.close())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*reports) if reports else [()] * 3, kinds)], REPORT.names)

    kinds = [pa.string(), pa.int64(), pa.int64()]
    as_text = joined.select(F.col("_id").cast("string").alias("_id"), "_url", F.col("refers_to").cast("string").alias("_target"), "_payload")
    return cut_lineage(as_text.mapInArrow(run, REPORT))


def qualified(spark, path: str) -> str:  # noqa: ANN001
    """The path with its scheme: one without belongs to the file system that is Spark's default."""
    of = spark._jvm.org.apache.hadoop.fs.Path(path)
    return of.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(of).toString()


def ranges_of(archive: str, range_bytes: int = RANGE_BYTES) -> Iterator[tuple[str, str, int, int]]:
    """(archive, member, start, length) that cover the records of all WARC members of a package.

    Bounds of records come from the indexes; a member that no index names is one range.
    """
    with ZipReader(archive) as package:
        members = package.members()
        places: dict[str, list[int]] = {}
        for m in members:
            if m.name.startswith("indexes/") and m.name.endswith((".cdx", ".cdxj")):
                for line in io.BytesIO(package.read(package.data_place(m), m.size)):
                    about = line[line.index(b"{") :] if b"{" in line else None
                    if about:
                        place = json.loads(about)
                        places.setdefault(place["filename"], []).append(int(place["offset"]))
        for m in members:
            if m.name.startswith("archive/") and m.name.endswith((".warc", ".warc.gz")):
                base = package.data_place(m)
                yield from _cut(archive, m, base, sorted({0, *places.get(m.name.rsplit("/", 1)[1], [])}), range_bytes)


def _cut(archive: str, member: Member, base: int, offsets: list[int], range_bytes: int) -> Iterator[tuple[str, str, int, int]]:
    start = 0
    for here, following in zip(offsets, [*offsets[1:], member.size]):
        if following - start > range_bytes and here > start:
            yield archive, member.name, base + start, here - start
            start = here
    if member.size > start:
        yield archive, member.name, base + start, member.size - start


def _unpacked(data: bytes) -> Iterator[bytes]:
    """Records of a range of gzip members. An opener copies what lies behind its member, so it is given pieces."""
    view, at = memoryview(data), 0
    while at < len(view):
        opener, parts = zlib.decompressobj(31), []
        while at < len(view) and not opener.eof:
            piece = view[at : at + PIECE_BYTES]
            parts.append(opener.decompress(piece))
            at += len(piece) - len(opener.unused_data)
        parts.append(opener.flush())
        yield b"".join(parts)


def _headers(data: bytes, start: int = 0) -> tuple[dict[str, str], int]:
    """Header fields by lower-cased name, and where the block begins."""
    stop = data.index(b"\r\n\r\n", start)
    fields = (line.partition(":") for line in data[start:stop].decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in fields}, stop + 4


def parse_records(data: bytes, compressed: bool) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of the WARC records in a range."""
    for part in _unpacked(data) if compressed else [data]:
        at = 0
        while at < len(part):
            fields, start = _headers(part, at)
            stop = start + int(fields["content-length"])
            yield fields, part[start:stop]
            at = stop + 4


def page_of(identifier: str | None) -> str | None:
    if identifier is None or not identifier.startswith("<urn:page:"):
        return identifier
    return unquote(identifier.removeprefix("<urn:page:").removesuffix(">")) or None


def described(fields: dict[str, str], block: bytes) -> tuple:
    """A record as a row: page, type, refers_to, url, payload length and digest, payload.

    The digest of a payload that is there is computed and compared with the one written; a revisit has the length and the
    digest of the payload it leaves out.
    """
    kind, digest, size, payload = fields.get("warc-type"), fields.get("warc-payload-digest"), len(block), block
    if digest is not None:
        digest = base64.b32decode(digest.removeprefix("sha1:")).hex()
    if fields.get("content-type", "").startswith("application/http"):
        http, start = _headers(block)
        payload = block[start:]
        size = int(http.get("content-length", len(payload))) if kind == "revisit" else len(payload)
    if kind == "revisit":
        payload = None
    else:
        computed = hashlib.sha1(payload).hexdigest()
        if digest not in (None, computed):
            raise ValueError(f"record {fields.get('warc-record-id')}: its payload has another digest than its header says")
        digest = computed
    return page_of(fields.get("warc-record-id")), kind, page_of(fields.get("warc-refers-to")), fields.get("warc-target-uri"), size, digest, payload


def read_packages(archives: DataFrame, with_payload: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per record of the packages listed in the column ``archive``: page, record_type, refers_to, url,
    payload_bytes, payload_digest (SHA-1, lower-case hex) and, if asked for, payload (null for revisits).

    An archive listed twice is read twice; null names and packages without WARC members give no rows. A package that is cut short, a
    compressed member or a wrong digest is an error.
    """
    spark = archives.sparkSession

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                found = list(zip(*ranges_of(archive, range_bytes)))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], RANGE.names)

    fields = [("page", pa.string(), T.StringType()), ("record_type", pa.string(), T.StringType()), ("refers_to", pa.string(), T.StringType()),
              ("url", pa.string(), T.StringType()), ("payload_bytes", pa.int64(), T.LongType()), ("payload_digest", pa.string(), T.StringType()),
              ("payload", pa.binary(), T.BinaryType())][: 7 if with_payload else 6]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, member, start, length in zip(*[batch.column(c).to_pylist() for c in RANGE.names]):
                with ZipReader(archive) as package:
                    data = package.read(start, length)
                rows = [described(f, b) for f, b in parse_records(data, member.endswith(".gz"))]
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t, _) in zip(columns, fields)], [n for n, _, _ in fields])

    ranges = archives.select("archive").filter("archive is not null").mapInArrow(listed, RANGE)
    # a fixed number of partitions: ranges are tiny rows that stand for megabytes, so merging small partitions would leave one task
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shape = T.StructType([T.StructField(n, t) for n, _, t in fields])
    return ranges.repartition(tasks, "archive", "member", "start").mapInArrow(read, shape)
