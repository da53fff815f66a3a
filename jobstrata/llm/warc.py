"""WARC records in ZIP packages: written by tasks, found through the packages' directories and indexes, read by range.

A package holds `archive/data.warc.gz` (stored; one gzip member per record) and `indexes/index.cdxj` (stored). Tasks write
packages under names of their own and return them as manifest rows; the manifest is a committed table, so a package left
behind by a lost or repeated task is in no manifest and is never read. Reading parses each package's central (or ZIP64)
directory, turns the index into one row per record, deals these out in blocks of a bounded number of bytes, and reads each
block's range. A package without an index is scanned record by record to make one.

Packages of other writers are read as well: all record types, plain or compressed archives and indexes, lengths and digests
that are left out, digests in base 16 or 32, chunked bodies."""
from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zipfile
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobstrata.llm import zipdir
from jobstrata.session import Stages, scratch_path

MIN_REVISIT_BYTES = 1000
PACKAGE_BYTES = 128 << 20
BLOCK_BYTES = 8 << 20
LEVEL = 6
WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def open_folder(uri: str):
    """(file system, path) of a shared folder or file."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri else pafs.FileSystem.from_uri("file://" + uri.removeprefix("file:"))


def record_name(page_id) -> str:
    return f"<urn:page:{page_id}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC record; a revisit keeps the HTTP header, with the length of the payload it leaves out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}",
            "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(33, 127)))))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_name(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case, the first of each; folded lines joined) and block of one WARC record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = _fields(lines[1:])
    size = int(fields["content-length"])
    if len(rest) < size:
        raise ValueError(f"{fields.get('warc-record-id', 'a record')} is cut short: {len(rest)} of {size} bytes")
    return fields, rest[:size]


def _fields(lines: list[str]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


class _Package:
    """One package being written, to a sink that need not be seekable."""

    def __init__(self, folder: str):
        store, path = open_folder(folder)
        self.name = f"part-{uuid.uuid4().hex}.wacz"
        self.sink = store.open_output_stream(f"{path}/{self.name}")
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member, self.at, self.lines = self.zip.open(zipfile.ZipInfo(WARC_MEMBER), "w", force_zip64=True), 0, []

    def add(self, data: bytes, level: int, entry: dict) -> None:
        packed = gzip.compress(data, level, mtime=0)
        self.member.write(packed)
        self.lines.append(json.dumps(entry | {"filename": WARC_MEMBER, "offset": self.at, "length": len(packed)}))
        self.at += len(packed)

    def close(self) -> tuple[str, int]:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX_MEMBER), "".join(f"{DATE} {x}\n" for x in self.lines))
        self.zip.close()
        n = len(self.lines)
        self.sink.close()
        return self.name, n


def revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, sha, refers_to of the pages whose payload, of min_bytes at least, a page of larger id has too.

    The largest id of each payload is a partial aggregate, so a payload that a third of all pages share costs each task one
    row. A null id is smaller than any other; rows that repeat the largest id are no revisits."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    keyed = pages.where(F.octet_length("html") >= min_bytes).select("page_id", F.sha2(payload, 256).alias("sha"))
    last = keyed.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null").drop("n")
    return keyed.join(last, "sha").where("not page_id <=> refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES, package_bytes: int = PACKAGE_BYTES, level: int = LEVEL) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html) and returns the manifest: path, length, n_records.

    Its rows must be kept in a table before use, since computing them writes the packages. A null html is an empty payload,
    a null url leaves the target out; rows that repeat are records of their own; no pages make no package."""
    refs = revisits(pages, min_bytes).withColumnsRenamed({"page_id": "_id", "sha": "_sha"})
    rows = pages.select("page_id", "url", "html", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("_key"))
    rows = rows.join(refs, rows["page_id"].eqNullSafe(refs["_id"]) & (rows["_key"] == refs["_sha"]), "left").select("page_id", "url", "html", "refers_to")

    def write(batches):
        out, open_, done = [], None, 0
        for b in batches:
            for page_id, url, html, refers_to in zip(*(b.column(c) for c in ("page_id", "url", "html", "refers_to"))):
                payload, page_id, refers_to = (html.as_py() or "").encode(), page_id.as_py(), refers_to.as_py()
                digest = hashlib.sha1(payload).hexdigest()
                open_ = open_ or _Package(folder)
                entry = {"url": url.as_py(), "digest": f"sha1:{digest}", "page_id": page_id}
                open_.add(record(page_id, url.as_py(), payload, digest, refers_to, refers_to is not None), level, entry)
                done += len(payload)
                if done >= package_bytes:
                    out, open_, done = out + [open_.close()], None, 0
        if open_:
            out.append(open_.close())
        yield pa.RecordBatch.from_pydict({"path": pa.array([f"{folder}/{n}" for n, _ in out], pa.string()), "n_records": pa.array([k for _, k in out], pa.int64())})

    return rows.mapInArrow(write, "path string, n_records long")


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """path of every package of a folder, listed by Spark without reading it."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wacz").load(folder).select("path")


def record_index(archives: DataFrame) -> DataFrame:
    """One row per record of the packages named by `path`: path, at (first byte in the package), length."""
    def locate(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                store, p = open_folder(path)
                with store.open_input_file(p) as f:
                    yield from _batches(path, _records(f, f.size()))
    return archives.select("path").mapInArrow(locate, "path string, at long, length long")


def _batches(path: str, records, size: int = 50_000):
    found = []
    for at, length in records:
        found.append((at, length))
        if len(found) == size:
            yield _index_batch(path, found)
            found = []
    yield _index_batch(path, found)


def _index_batch(path: str, found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"path": pa.array([path] * len(found), pa.string()), "at": pa.array([a for a, _ in found], pa.int64()), "length": pa.array([n for _, n in found], pa.int64())})


def _records(f, length: int):
    """(first byte, length) of each record: from the indexes, or by a scan of archives that no index names.

    Indexes name an archive by its whole member name or by the part below `archive/`."""
    directory = zipdir.members(f, length)
    archives = {m.name: (zipdir.data_at(f, m), m.size) for m in directory if m.name.startswith("archive/") and m.name.endswith((".warc.gz", ".warc"))}
    named = set()
    for m in directory:
        if m.name.startswith("indexes/") and m.name.endswith((".cdxj", ".cdx.gz", ".cdxj.gz")):
            for line in _lines(f, zipdir.data_at(f, m), m.size, m.name.endswith(".gz")):
                if b"{" not in line:  # a comment or an empty line
                    continue
                entry = json.loads(line[line.index(b"{"):])
                name = entry["filename"] if entry["filename"] in archives else f"archive/{entry['filename']}"
                if name not in archives:
                    raise ValueError(f"{m.name} names {entry['filename']}, which the package does not hold")
                named.add(name)
                yield archives[name][0] + int(entry["offset"]), int(entry["length"])
    for name in sorted(archives.keys() - named):
        at, size = archives[name]
        for offset, n in (_scan if name.endswith(".gz") else _scan_plain)(f, at, size):
            yield at + offset, n


def _lines(f, at: int, size: int, packed: bool, step: int = 1 << 20):
    """Lines of a stored member, plain or of gzip members, read in pieces of `step` bytes; only \\n ends a line."""
    rest, unzip = b"", zlib.decompressobj(31)
    for p in range(0, size, step):
        piece = zipdir.read_at(f, at + p, min(step, size - p))
        while piece:
            text, piece = (unzip.decompress(piece), unzip.unused_data) if packed else (piece, b"")
            if packed and unzip.eof:
                unzip = zlib.decompressobj(31)
            *whole, rest = (rest + text).split(b"\n")
            yield from whole
    if rest:
        yield rest


def _scan(f, at: int, size: int, step: int = 1 << 20):
    """Offset and length of each gzip member of an archive, reading `step` bytes at a time."""
    offset, p, left, unzip = 0, 0, b"", zlib.decompressobj(31)
    while p < size or left:
        if not left:
            left = zipdir.read_at(f, at + p, min(step, size - p))
            p += len(left)
        while left:
            unzip.decompress(left)
            left = unzip.unused_data
            if unzip.eof:
                end = p - len(left)
                yield offset, end - offset
                offset, unzip = end, zlib.decompressobj(31)


def _scan_plain(f, at: int, size: int, step: int = 1 << 14):
    """Offset and length of each record of an uncompressed archive; blocks are skipped, not read."""
    offset = 0
    while offset < size:
        head = b""
        while b"\r\n\r\n" not in head:
            more = zipdir.read_at(f, at + offset + len(head), min(step, size - offset - len(head)))
            if not more:
                raise ValueError("an archive ends inside a record's header")
            head += more
        fields = _fields(head[: head.index(b"\r\n\r\n")].decode("utf-8", "replace").split("\r\n")[1:])
        n = head.index(b"\r\n\r\n") + 4 + int(fields["content-length"]) + 4
        yield offset, min(n, size - offset)
        offset += n


READ = "record_id string, page_id long, url string, record_type string, refers_to_id string, refers_to long, payload binary, payload_bytes long, payload_digest string"


def read_records(index: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The records of an index, of any type and writer: record_id, page_id, url, record_type, refers_to_id, refers_to,
    payload, payload_bytes, payload_digest.

    page_id and refers_to are null where a record id is not one of this writer's. The payload is the body of an HTTP message
    (chunks put together, content encodings left as they are), else the whole block; null for a revisit. The digest is the
    SHA-1 in lower-case hex. A stated digest, in base 16 or 32, must be that of the payload, with or without its chunk
    marks; other algorithms that hashlib has are checked as well, unknown ones are not. A revisit has the digest and length
    that its record states, null where it states none. Records of one block of a package are read by one range read."""
    partitions = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, so that the short index rows are not dealt to one task
    dealt = index.withColumn("_block", F.floor(F.col("at") / block_bytes)).repartition(partitions, "path", "_block").sortWithinPartitions("path", "at")

    def read(batches):
        for b in batches:
            places = list(zip(b.column("path").to_pylist(), b.column("at").to_pylist(), b.column("length").to_pylist()))
            i = 0
            while i < len(places):
                path, at, length = places[i]
                j, end = i + 1, at + length
                while j < len(places) and places[j][0] == path and places[j][1] <= end + block_bytes // 8 and places[j][1] + places[j][2] - at <= block_bytes:
                    end = max(end, places[j][1] + places[j][2])
                    j += 1
                store, p = open_folder(path)
                with store.open_input_file(p) as f:
                    data = zipdir.read_at(f, at, end - at)
                yield _parsed([_unpacked(data[a - at: a - at + n]) for _, a, n in places[i:j]])
                i = j
    return dealt.mapInArrow(read, READ)


def _unpacked(data: bytes) -> bytes:
    return gzip.decompress(data) if data.startswith(b"\x1f\x8b") else data


def _id(name: str | None) -> int | None:
    """The number in a record id of this writer, null for any other."""
    number = re.fullmatch(r"<urn:page:(-?[0-9]{1,19})>", name or "")
    return int(number[1]) if number else None


def _whole(body: bytes) -> bytes | None:
    """A chunked body without its chunk marks; null if it is not one."""
    out, p = [], 0
    while True:
        line = body.find(b"\r\n", p)
        size = re.fullmatch(rb"[ \t]*([0-9A-Fa-f]+)[ \t]*(?:;.*)?", body[p:line], re.S) if line >= 0 else None
        if size is None:
            return None
        n, p = int(size[1], 16), line + 2
        if n == 0:
            return b"".join(out)
        if body[p + n: p + n + 2] != b"\r\n":
            return None
        out.append(body[p: p + n])
        p += n + 2


def _digest(stated: str | None) -> tuple[str, str] | None:
    """(algorithm, lower-case hex) of a stated digest in base 16 or 32; null if there is none or its algorithm is unknown."""
    kind, _, value = (stated or "").partition(":")
    kind, value = kind.strip().lower().replace("-", ""), value.strip()
    if kind not in ("md5", "sha1", "sha256", "sha384", "sha512"):
        return None
    size = hashlib.new(kind).digest_size
    if re.fullmatch(f"[0-9A-Fa-f]{{{2 * size}}}", value):
        return kind, value.lower()
    value = value.rstrip("=").upper()
    if not re.fullmatch("[A-Z2-7]+", value) or len(value) != -(-size * 8 // 5):
        raise ValueError(f"{stated} is no {kind} digest in base 16 or 32")
    return kind, base64.b32decode(value + "=" * (-len(value) % 8)).hex()


def _parsed(records: list[bytes]) -> pa.RecordBatch:
    rows = []
    for data in records:
        fields, block = parse(data)
        kind, http = fields["warc-type"], {}
        body = block
        if fields.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
            head, _, body = block.partition(b"\r\n\r\n")
            http = _fields(head.decode("latin-1").split("\r\n")[1:])
        payload = body
        if "chunked" in http.get("transfer-encoding", "").lower():
            whole = _whole(body)
            payload = body if whole is None else whole
        stated = _digest(fields.get("warc-payload-digest"))
        if kind == "revisit":
            length = http.get("content-length", "")
            row = (None, int(length) if length.isdecimal() else None, stated[1] if stated and stated[0] == "sha1" else None)
        else:
            if stated and "warc-truncated" not in fields and stated[1] not in (hashlib.new(stated[0], payload).hexdigest(), hashlib.new(stated[0], body).hexdigest()):
                raise ValueError(f"the payload of {fields.get('warc-record-id')} is damaged")
            row = (payload, len(payload), hashlib.sha1(payload).hexdigest())
        name, refers = fields.get("warc-record-id"), fields.get("warc-refers-to")
        rows.append((name, _id(name), fields.get("warc-target-uri"), kind, refers, _id(refers), *row))
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string())
    names = [x.split()[0] for x in READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def archived_pages(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes all pages below the shared folder and reads the packages back: one row per page."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "packages")
    one = pages.select(F.col("page_id").cast("long"), "url", "html")
    if "://" not in folder:
        folder = "file://" + folder.removeprefix("file:")
    open_folder(folder)[0].create_dir(open_folder(folder)[1], recursive=True)
    manifest = Stages(spark).keep(write_archives(one, folder, min_bytes, package_bytes), "manifest")
    back = read_records(record_index(manifest))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


PAGES_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN strlen(html) >= {MIN_REVISIT_BYTES} AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(html) >= {MIN_REVISIT_BYTES} AND page_id <> last THEN last END AS refers_to
FROM g
"""
