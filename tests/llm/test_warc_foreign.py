"""Packages that others wrote: several archives, CDXJ indexes, plain and unindexed archives."""

import gzip
import hashlib
import io
import json
import zipfile

import pytest

from uttera.llm import warc
from uttera.session import ship


def record(kind, name, payload, **more):
    block = payload if kind in ("resource", "warcinfo") else b"HTTP/1.1 200 OK\r\n\r\n" + payload
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{name}>", "WARC-Target-URI": f"http://{name}/", "Content-Length": len(block)} | more
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def package():
    """a: gzipped, in a CDXJ index; b: plain, in a gzipped index; c: gzipped, in no index; d: plain, in none."""
    parts = {x: [record("response", f"{x}{k}", f"payload {x} {k}".encode() * 50) for k in range(40)] for x in "abcd"}
    parts["a"].insert(0, record("warcinfo", "info", b"software: x"))
    parts["b"].append(record("resource", "plain", b"no http\r\n\r\nhere"))
    stored = {f"{x}.warc" + ".gz" * (x in "ac"): [gzip.compress(r) if x in "ac" else r for r in rows] for x, rows in parts.items()}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        lines = {"a.warc.gz": [], "b.warc": []}
        for name, rows in stored.items():
            z.writestr(f"archive/{name}", b"".join(rows))
            at = 0
            for r in rows:
                if name in lines:
                    lines[name].append(f"com,x)/ 2024 {json.dumps({'offset': str(at), 'length': str(len(r)), 'filename': name})}\n".encode())
                at += len(r)
        z.writestr("indexes/index.cdxj", b"".join(lines["a.warc.gz"]))
        half = len(lines["b.warc"]) // 2
        z.writestr("indexes/b.cdx.gz", gzip.compress(b"".join(lines["b.warc"][:half])) + gzip.compress(b"".join(lines["b.warc"][half:])))
        z.writestr("pages/pages.jsonl", b'{"offset": 1}')
        z.writestr("datapackage.json", b"{}")
    return out.getvalue()


def test_foreign_package(spark, tmp_path):
    ship(spark)
    data = package()
    (tmp_path / "x.wacz").write_bytes(data)
    rows = spark.createDataFrame([(f"file://{tmp_path}/x.wacz", len(data))], "path string, size long")
    got = {r.url: r for r in warc.read(rows).collect()}
    assert len(got) == 161 and {r.page_id for r in got.values()} == {None}
    for x in "abcd":
        for k in range(40):
            payload = f"payload {x} {k}".encode() * 50
            r = got[f"http://{x}{k}/"]
            assert (bytes(r.payload), r.payload_digest, r.payload_bytes) == (payload, hashlib.sha256(payload).hexdigest(), len(payload))
    assert bytes(got["http://plain/"].payload) == b"no http\r\n\r\nhere"


def test_ranges_join_neighbours(monkeypatch):
    data = package()
    read = lambda at, n: data[at : at + n]
    found = warc.ranges_of(read, len(data))
    assert len(found) == 4 and sorted(len(x[2]) for x in found if x[2]) == [41, 41]
    monkeypatch.setattr(warc, "RANGE", 1)
    assert sum(len(x[2]) for x in warc.ranges_of(read, len(data)) if x[2]) == 82


def test_cut_record():
    with pytest.raises(ValueError, match="early"):
        list(warc.split_records(gzip.compress(b"x" * 1000)[:-20], None))


def test_many_tasks_read(spark, monkeypatch):
    """The read stage is cut by bytes, not merged to one task."""
    ship(spark)
    monkeypatch.setattr(warc, "RANGE", 2_000)
    pages = spark.range(300).selectExpr("id AS page_id", "'u' AS url", "sha2(cast(id AS string), 512) || sha2(cast(-id AS string), 512) AS html")
    packages = warc.write(pages)
    assert warc.read(packages).rdd.getNumPartitions() > 5 and warc.read(packages).count() == 300
