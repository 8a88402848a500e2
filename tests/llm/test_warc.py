import hashlib
import io
import random
import zipfile

import pytest

from uttera.llm import warc
from uttera.session import ship

SCHEMA = "page_id long, url string, html string, digest string"


def rows_of(spark, pages):
    ship(spark)
    return warc.read(warc.write(spark.createDataFrame(pages, SCHEMA)))


def test_edge_cases(spark):
    long = "x" * 3_000_000
    pages = [
        (5, "http://a/", "p" * 100, "clash"), (3, "http://b/\r\nX: y", "p" * 100, None), (9, None, "p" * 100, None),
        (1, "u", "short", None), (2, "u", "short", None), (4, "u", None, None), (6, "u", "", None), (7, "u", "é\r\n\r\nWARC/1.1", None),
        (8, "u", long, None), (3, "again", "p" * 100, None), (None, "n", "p" * 100, None), (None, "n", "only" * 50, None),
    ]
    got = rows_of(spark, pages).collect()
    assert len(got) == len(pages)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    for page_id, _, html, _ in pages:
        raw = (html or "").encode()
        assert all(r.payload_bytes == len(raw) and r.payload_digest == hashlib.sha256(raw).hexdigest() for r in by[page_id] if page_id is not None)
    assert {r.record_type for r in by[3]} == {"response"} and len(by[3]) == 2
    assert [(r.record_type, r.refers_to) for r in by[5] + by[9]] == [("revisit", 3)] * 2
    assert sorted((r.record_type, r.refers_to) for r in by[None]) == [("response", None), ("revisit", 3)]
    assert by[1][0].record_type == by[2][0].record_type == "response"
    assert by[8][0].payload == long.encode() and by[7][0].payload == "é\r\n\r\nWARC/1.1".encode()


def test_empty_table(spark):
    assert rows_of(spark, []).count() == 0


def reader(data):
    return lambda at, n: data[at : at + n]


def test_directories():
    rng = random.Random(1)
    parts = {f"m{k}": rng.randbytes(rng.randrange(200)) for k in range(20)}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = b"PK\x05\x06 in a comment"
        for name, data in parts.items():
            with z.open(name, "w", force_zip64=int(name[1:]) % 2 == 0) as f:
                f.write(data)
    data = out.getvalue()
    for m in warc.members(reader(data), len(data)):
        at = warc.data_offset(reader(data), m)
        assert data[at : at + m.size] == parts[m.name]


def test_zip64_end_record():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k in range(66_000):  # over 65,535 members need the ZIP64 end record
            z.writestr(zipfile.ZipInfo(str(k)), b"%d" % k)
    data = out.getvalue()
    found = warc.members(reader(data), len(data))
    assert len(found) == 66_000
    at = warc.data_offset(reader(data), found[65_999])
    assert data[at : at + 5] == b"65999"


def test_zip64_fields():
    """A member whose sizes and offset stand in its ZIP64 extra field."""
    import struct

    name, body = b"a", b"payload"
    local = warc._LOCAL + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, 20) + name + struct.pack("<HHQQ", 1, 16, 7, 7)
    extra = struct.pack("<HHQQQ", 1, 24, 7, 7, 0)
    entry = warc._ENTRY + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    start = len(local) + len(body)
    end64 = warc._END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), start)
    locator = warc._LOCATOR + struct.pack("<IQI", 0, start + len(entry), 1)
    end = warc._END + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    data = local + body + entry + end64 + locator + end
    (m,) = warc.members(reader(data), len(data))
    at = warc.data_offset(reader(data), m)
    assert data[at : at + m.size] == body


def test_broken_files():
    with pytest.raises(ValueError):
        warc.members(reader(b"nothing"), 7)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"x" * 100)
    data = out.getvalue()
    (m,) = warc.members(reader(data), len(data))
    with pytest.raises(ValueError, match="compressed"):
        warc.data_offset(reader(data), m)
