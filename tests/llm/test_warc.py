import base64
import gzip
import hashlib
import io
import random
import zipfile

import pytest

from jobstrata.llm import warc, zipdir
from jobstrata.session import Stages, scratch_path


def expected(rows, least=1000):
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        ids = [j for j, _, x in rows if (x or "").encode() == p and j is not None]
        revisit = len(p) >= least and bool(ids) and i != max(ids)
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", max(ids) if revisit else None))
    return sorted(out, key=repr)


ROWS = [(i, f"http://a/{i}", "é" * (i % 7) * 100 + "x" * (i % 11)) for i in range(120)]
ROWS += [(200, None, None), (201, "http://b/ü\r\nX: y", ""), (202, "u", "</html>\r\n\r\nWARC/1.1" * 90), (203, "u", "</html>\r\n\r\nWARC/1.1" * 90), (203, "u", "</html>\r\n\r\nWARC/1.1" * 90),
         (None, "u", "</html>\r\n\r\nWARC/1.1" * 90), (205, "u", "z" * 400000), (206, "u", "q" * 999), (207, "u", "q" * 999)]


@pytest.mark.parametrize("package_bytes", [1 << 27, 3000])
def test_round_trip(spark, package_bytes):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 as length", "'p' as path")
    got = warc.archived_pages(pages, package_bytes=package_bytes).collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected(ROWS)
    assert warc.archived_pages(pages.limit(0)).count() == 0


def test_packages_listed_payloads_and_missing_index(spark):
    folder = "file://" + scratch_path(spark, "w").removeprefix("file:")
    store, path = warc.open_folder(folder)
    store.create_dir(path, recursive=True)
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    manifest = Stages(spark).keep(warc.write_archives(pages, folder)).collect()
    for r in manifest:  # the same packages without their indexes
        with zipfile.ZipFile(warc.open_folder(r.path)[1]) as z:
            data = z.read(warc.WARC_MEMBER)
        with zipfile.ZipFile(warc.open_folder(r.path)[1], "w") as z:
            z.writestr(warc.WARC_MEMBER, data)
    rows = warc.read_records(warc.record_index(warc.list_archives(spark, folder)), block_bytes=5000).collect()
    html = {}
    for i, _, h in ROWS:
        html[i] = (h or "").encode()
    assert len(rows) == len(ROWS) == sum(r.n_records for r in manifest)
    assert all(bytes(r.payload) == html[r.page_id] for r in rows if r.record_type == "response")
    assert all(r.payload is None and len(html[r.refers_to]) == r.payload_bytes for r in rows if r.record_type == "revisit")


@pytest.mark.parametrize("limit", [None, 20])
def test_directories(monkeypatch, limit):
    if limit:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    out, rnd = io.BytesIO(), random.Random(2)
    with zipfile.ZipFile(out, "w") as z:
        for i in range(5):
            z.writestr(zipfile.ZipInfo(f"archive/é{i}"), rnd.randbytes(50 + i))
        z.comment = b"a comment"
    with zipfile.ZipFile(out) as z:
        want = [(i.filename, i.file_size, z.read(i)) for i in z.infolist()]
    found = zipdir.members(out, len(out.getvalue()))
    assert [(m.name, m.size, zipdir.read_at(out, zipdir.data_at(out, m), m.size)) for m in found] == want
    with pytest.raises(ValueError):
        zipdir.members(io.BytesIO(b"no package at all, only text"), 28)


def foreign(kind, block, *fields, name="<urn:uuid:0-1>"):
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", *fields, f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def foreign_records():
    body, http = "grüße".encode() * 50, b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n"
    chunks = b"5;x=1\r\n" + body[:5] + b"\r\n" + b"%X\r\n" % (len(body) - 5) + body[5:] + b"\r\n0\r\nTrailer: a\r\n\r\n"
    base32 = "WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    app = "Content-Type: application/http; msgtype=response"
    url = "WARC-Target-URI: http://a/ x"
    return body, [
        (foreign("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"), ("warcinfo", b"software: x\r\n")),
        (foreign("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "Content-Type: application/http;msgtype=request", url), ("request", b"")),
        (foreign("response", http + b"\r\n" + body, app, url, base32), ("response", body)),
        (foreign("response", http + b"Transfer-Encoding: chunked\r\n\r\n" + chunks, app, base32.replace("sha1", "SHA1")), ("response", body)),
        (foreign("response", http + b"Transfer-Encoding: chunked\r\n\r\n" + body, app), ("response", body)),   # says so, but is not
        (foreign("response", http + b"Transfer-Encoding: chunked\r\n\r\n" + chunks, app, f"WARC-Payload-Digest: sha256:{hashlib.sha256(chunks).hexdigest()}"), ("response", body)),
        (foreign("resource", body, "Content-Type: text/plain", f"WARC-Payload-Digest: md5:{hashlib.md5(body).hexdigest().upper()}"), ("resource", body)),
        (foreign("metadata", b"a: 1", "WARC-Refers-To: <urn:uuid:0-1>", "X-Folded: a\r\n  b"), ("metadata", b"a: 1")),
        (foreign("response", http + b"\r\n" + body[:9], app, base32, "WARC-Truncated: length"), ("response", body[:9])),
        (foreign("revisit", http + b"\r\n", app, base32, "WARC-Refers-To: <urn:uuid:0-1>"), ("revisit", None)),
        (foreign("revisit", b"", base32.split(":")[0] + ": crc9:00"), ("revisit", None)),
        (foreign("response", b"HTTP/1.1 200 OK\r\n\r\n", app, name="<urn:page:12>"), ("response", b"")),
    ]


@pytest.mark.parametrize("layout", ["scan", "plain", "index", "packed index"])
def test_foreign_archives(spark, layout):
    body, made = foreign_records()
    folder = "file://" + scratch_path(spark, "w").removeprefix("file:")
    store, path = warc.open_folder(folder)
    store.create_dir(path, recursive=True)
    parts = [r if layout == "plain" else gzip.compress(r) for r, _ in made]
    name = "data.warc" if layout == "plain" else "data.warc.gz"
    at, lines = 0, ["!meta a comment"]
    for p in parts:
        lines.append('a,x)/  2024 {"url": "x y", "filename": "%s", "offset": "%d", "length": "%d"}' % (name, at, len(p)))
        at += len(p)
    with zipfile.ZipFile(f"{path}/a.wacz", "w") as z:
        z.writestr(f"archive/{name}", b"".join(parts))
        z.writestr("pages/pages.jsonl", "{}")
        if "index" in layout:
            text = ("\n".join(lines) + "\n").encode()
            packed = layout != "index"
            z.writestr("indexes/index.cdx.gz" if packed else "indexes/index.cdxj", gzip.compress(text[:99]) + gzip.compress(text[99:]) if packed else text)
    index = Stages(spark).keep(warc.record_index(warc.list_archives(spark, folder)))
    rows = index.orderBy("at").collect()
    got = {}
    for r in warc.read_records(index).collect():
        got.setdefault((r.record_type, None if r.payload is None else bytes(r.payload)), []).append(r)
    want = [w for _, w in made]
    assert len(rows) == len(made) and sorted(map(repr, (k for k, v in got.items() for _ in v))) == sorted(map(repr, want))
    assert all(r.payload_digest == hashlib.sha1(k[1]).hexdigest() and r.payload_bytes == len(k[1]) for k, v in got.items() for r in v if k[1] is not None)
    assert {(r.payload_digest, r.payload_bytes, r.refers_to_id, r.refers_to) for r in got["revisit", None]} == {(hashlib.sha1(body).hexdigest(), None, "<urn:uuid:0-1>", None), (None, None, None, None)}
    assert [r.page_id for r in got["response", b""]] == [12] and got["request", b""][0].url == "http://a/ x"


def test_damage_is_found():
    body = b"HTTP/1.1 200 OK\r\n\r\nabc"
    wrong = "WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(b"abd").digest()).decode()
    for r in (foreign("response", body, "Content-Type: application/http", wrong), foreign("response", body)[:-9], b"HTTP/1.1 200 OK\r\n\r\n"):
        with pytest.raises(ValueError):
            warc._parsed([r])
