"""WARC records in ZIP packages: written as stored members with an index, range-read without extraction.

A package is a ZIP file with two stored members: `archive/data.warc.gz`, one gzip member a record, and
`indexes/index.jsonl`, a line with offset and length for each record. The reader parses the end record, the
ZIP64 locator and end record where there is one, the central directory with its ZIP64 fields, and each member's local header; it
then reads byte ranges of the package and nothing else. Packages of others are read alike: every archive under `archive/`,
located by the index lines (JSON, also behind a key and a time as in CDXJ, also gzipped) of any file under `indexes/` that
name a file, an offset and a length; an archive that no index names is read whole, record by record.

Paths are opened through pyarrow's file systems, so executors read and write the shared folder of any store that these know.

Defined cases: a null html is an empty payload; a null url becomes urn:none; control characters in a url are
percent-encoded. Among records of one payload of at least MIN_REVISIT bytes, those with the smallest page id are
responses (several, if rows repeat that id), the others revisit it; a record without an id is a response only where
no id is known. An empty table writes nothing and reads nothing. Extra columns are ignored. Read back, records that are
neither responses, revisits nor resources are left out; a record whose id names no page has a null page_id; a compressed member raises.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uttera.llm.common import salted_lookup, shared_path, small_batches, written

MIN_REVISIT = 100
#: Compressed bytes of records in a package, and of one range read.
PACKAGE, RANGE = 48 << 20, 4 << 20
#: Tasks of a stage, at most; each then takes several packages or ranges, one after the other.
TASKS = 20_000
DATE = "2024-01-01T00:00:00Z"

# ---- ZIP --------------------------------------------------------------------------------------------------

_END, _LOCATOR, _END64, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    stored: int
    header: int


def members(read: Callable[[int, int], bytes], size: int) -> list[Member]:
    """The central directory of a ZIP file. read(offset, length) gives bytes of the file."""
    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(_END)
    while at >= 0 and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail):
        at = tail.rfind(_END, 0, at)  # a comment may hold the signature
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
    locator = read(tail_at + at - 20, 20) if tail_at + at >= 20 else b""
    if locator[:4] == _LOCATOR:
        end = read(int.from_bytes(locator[8:16], "little"), 56)
        if end[:4] != _END64:
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack("<QQQ", end[32:56])
    directory, out, p = read(start, length), [], 0
    for _ in range(count):
        if directory[p : p + 4] != _ENTRY:
            raise ValueError("broken central directory")
        flags, method = struct.unpack("<HH", directory[p + 8 : p + 12])
        stored, full, n_name, n_extra, n_comment = struct.unpack("<IIHHH", directory[p + 20 : p + 34])
        header = int.from_bytes(directory[p + 42 : p + 46], "little")
        name = directory[p + 46 : p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[p + 46 + n_name : p + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:  # ZIP64: 8 bytes for each field that is full, in this order
                wide = iter(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                full = next(wide) if full == 0xFFFFFFFF else full
                stored = next(wide) if stored == 0xFFFFFFFF else stored
                header = next(wide) if header == 0xFFFFFFFF else header
            extra = extra[4 + n :]
        out.append(Member(name, method, full, stored, header))
        p += 46 + n_name + n_extra + n_comment
    return out


def data_offset(read: Callable[[int, int], bytes], member: Member) -> int:
    """Where the bytes of a stored member begin."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed; only stored members can be range-read")
    head = read(member.header, 30)
    if head[:4] != _LOCAL:
        raise ValueError(f"no local header for {member.name}")
    return member.header + 30 + sum(struct.unpack("<HH", head[26:30]))


# ---- WARC -------------------------------------------------------------------------------------------------


def _uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:none"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit holds the HTTP head alone, which names the payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_uri(url)}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers, payload. Names in lower case."""
    fields = lambda raw: {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in raw.decode().split("\r\n")[1:])}
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    warc = fields(head)
    block = rest[: int(warc["content-length"])]
    if warc.get("warc-type") == "resource":
        return warc, {}, block
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


def split_records(data: bytes, lengths: list[int] | None) -> Iterator[bytes]:
    """Records of a range: by the index's lengths, or one after the other where there is no index."""
    if lengths is not None:
        at = 0
        for n in lengths:
            part = data[at : at + n]
            yield part if part[:5] == b"WARC/" else zlib.decompress(part, 31)
            at += n
        return
    at = 0
    while at < len(data):
        if data[at : at + 5] == b"WARC/":
            head = data.index(b"\r\n\r\n", at) + 4
            length = re.search(rb"(?i)\r\ncontent-length: *([0-9]+)", data[at:head])
            end = head + int(length[1]) + 4
            yield data[at:end]
            at = end
            continue
        z, out = zlib.decompressobj(31), []
        while not z.eof:  # fed in pieces, so that what is left over is never copied whole
            piece = data[at : at + 65_536]
            if not piece:
                raise ValueError("a record ends early")
            out.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        yield b"".join(out)


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)  # no time stamp: equal records are equal bytes
    return z.compress(data) + z.flush()


# ---- files ------------------------------------------------------------------------------------------------


def _store(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def write_package(uri: str, data: list[bytes], index: list[dict]) -> int:
    """A package written beside its place and moved there, so that no reader sees a part of one."""
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for name, parts in (("archive/data.warc.gz", data), ("indexes/index.jsonl", [(json.dumps(x) + "\n").encode() for x in index])):
            with z.open(zipfile.ZipInfo(name), "w") as f:
                for part in parts:
                    f.write(part)
    fs, path = _store(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as f:
        f.write(body.getbuffer())
    fs.move(part, path)
    return body.tell()


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the name carries the attempt: a repeated task writes files of its own, and only a finished one's are listed
        task, attempt, number = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0
        data: list[bytes] = []
        index: list[dict] = []
        at = 0

        def close() -> pa.RecordBatch:
            nonlocal data, index, at, number
            uri = f"{folder}/{task:06d}-{attempt}-{number:04d}.wacz"
            size = write_package(uri, data, index)
            out = pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([size], pa.int64()), pa.array([len(index)], pa.int64())], ["path", "size", "records"])
            data, index, at, number = [], [], 0, number + 1
            return out

        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                packed = gzip_member(record(page_id, url, html or b"", digest, refers_to))
                index.append({"id": page_id, "offset": at, "length": len(packed)})
                data.append(packed)
                at += len(packed)
                if at >= PACKAGE:
                    yield close()
        if data:
            yield close()

    return run


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages (page_id, url, html) as packages; returns path, size, records of each package."""
    small_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    # equal payloads: partial minima before the shuffle; only payloads that recur are looked up, on salted keys
    firsts = rows.where(F.octet_length("html") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    rows = salted_lookup(rows, firsts.select("digest", "first"), ["digest"], F.col("page_id"))
    refers = F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first"))
    rows = rows.withColumn("refers_to", F.when(F.octet_length("html") >= MIN_REVISIT, refers)).select("page_id", "url", "html", "digest", "refers_to")
    folder = folder or shared_path(pages.sparkSession, "warc")
    return written(rows.sortWithinPartitions("page_id").mapInArrow(_writer(folder), "path string, size long, records long"), "packages")


def index_lines(data: bytes) -> Iterator[dict]:
    """The JSON objects of an index's lines that say where a record is."""
    if data[:2] == b"\x1f\x8b":
        data = b"".join(split_records(data, None))
    for line in data.splitlines():
        at = line.find(b"{")
        if at >= 0:
            x = json.loads(line[at:])
            if "offset" in x and "length" in x:
                yield x


def ranges_of(read: Callable[[int, int], bytes], size: int) -> list[tuple[int, int, list[int] | None]]:
    """(start, length, lengths of the records or None) of the byte ranges of a package, from directory and index alone."""
    found = members(read, size)
    archives = {m.name.rpartition("/")[2]: m for m in found if m.name.startswith("archive/") and m.size}
    at = {name: data_offset(read, m) for name, m in archives.items()}
    records: dict[str, list[tuple[int, int]]] = {name: [] for name in archives}
    for m in found:
        if m.name.startswith("indexes/") and m.size:
            for x in index_lines(read(data_offset(read, m), m.size)):
                name = x.get("filename", "").rpartition("/")[2] or (next(iter(archives)) if len(archives) == 1 else "")
                if name in records:
                    records[name].append((int(x["offset"]), int(x["length"])))
    out: list[tuple[int, int, list[int] | None]] = []
    for name, m in archives.items():
        if not records[name]:
            out.append((at[name], m.size, None))
        last = -1  # where the open range ends
        for offset, length in sorted(set(records[name])):
            if offset == last and out[-1][1] + length <= RANGE:
                out[-1] = (out[-1][0], out[-1][1] + length, [*out[-1][2], length])
            else:
                out.append((at[name] + offset, length, [length]))
            last = offset + length
    return out


_RANGES = "path string, start long, length long, lengths array<long>"


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, size in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist(), strict=True):
            fs, path = _store(uri)
            with fs.open_input_file(path) as f:
                out = [(uri, *r) for r in ranges_of(lambda at, n, f=f: f.read_at(n, at), size)]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["path", "start", "length", "lengths"])


_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _id(urn: str) -> int | None:
    value = urn.strip("<>").removeprefix("urn:page:")
    return int(value) if re.fullmatch("-?[0-9]+", value) else None


def _reader(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start, length, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, path = _store(uri)
                with fs.open_input_file(path) as f:
                    data = f.read_at(length, start)
                out = []
                for raw in split_records(data, lengths):
                    warc, http, payload = parse_record(raw)
                    kind = warc["warc-type"]
                    if kind not in ("response", "revisit", "resource"):
                        continue
                    algorithm, _, digest = warc.get("warc-payload-digest", "").partition(":")
                    size = int(http["content-length"]) if kind == "revisit" and "content-length" in http else len(payload)
                    if kind != "revisit":
                        own = hashlib.sha256(payload).hexdigest()
                        if algorithm == "sha256" and digest != own:
                            raise ValueError(f"{uri}: the payload of {warc['warc-record-id']} doesn't have its digest")
                        digest = own
                    refers = _id(warc["warc-refers-to"]) if "warc-refers-to" in warc else None
                    out.append((_id(warc["warc-record-id"]), warc.get("warc-target-uri"), size, digest, kind, refers, payload if payloads else None))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], x.type) for k, x in enumerate(_READ)], schema=_READ)

    return run


def read(packages: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of packages (path, size): ranges are found from the index, dealt out and read. Digests are verified.

    Rows are small here and the work behind them is large, so they are dealt to numbers of partitions that adaptive execution
    leaves alone: a package each to be listed, a range each to be read.
    """
    total = packages.agg(F.count("*").alias("n"), F.sum("size").alias("b")).first()
    listed, ranges = max(1, total["n"]), max(1, -(-(total["b"] or 0) // RANGE))
    rows = packages.select("path", "size").repartition(min(listed, TASKS), "path").mapInArrow(_ranges, _RANGES)
    return rows.repartition(min(ranges, TASKS), "path", "start").mapInArrow(
        _reader(payloads), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    )
