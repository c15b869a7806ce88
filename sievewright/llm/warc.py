"""WARC archives with a two-level capture index.

Archives are plain WARC/1.1 files of gzip members, a member or more for each record, as other tools read them. Spark's text writer puts
them into the shared folder: a row is a member without its last byte, and the line separator, one zero byte, is that byte. (The
last byte of a gzip member is the highest of its length, and members hold less than 16 MB.) So files are committed as any
table of Spark's is, a lost task leaves nothing behind, and no executor opens a file to write.

The index has a line for each capture: its key (host labels reversed, port, path and query), its number, and a JSON object with file, offset
and length. Lines are sorted over all parts by ranges, and each part holds them in compressed blocks, then its directory (the
first key, place and size of each block), then the directory's place. A lookup bisects the first keys of parts, which are as
many as there are parts and all that the driver gathers, then the part's directory, then the block's lines; each is read by its range. Records
are then read by ranges, sorted by place, neighbours at once. Executors open the shared folder by pyarrow, so it has to be of a kind that pyarrow knows
(file, hdfs, s3, gs).

Pages: a null html is an empty payload, a null url is named by its page, and null page_ids stay, but none is what others refer to.
Rows with the same page_id and payload are of the same kind, so several may be responses. Payloads of any size are taken whole. Extra columns are left out, and an
empty table gives no archives.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import struct
import urllib.parse
import uuid
import zlib
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_path, lean, stored

#: Bytes of a record in one gzip member; a longer record has several.
MEMBER = 15 << 20
#: Lines of a block of the index.
LINES = 2000
#: Records nearer than GAP bytes are read at once, up to READ bytes.
GAP, READ = 1 << 16, 8 << 20
LEVEL = 6
CRLF = b"\r\n"
_TRAILER = struct.Struct("<QQ")


class Archives(NamedTuple):
    """Folders of the record files and of the index, and the first line of each part of the index that has some, with its file, in order."""

    files: str
    index: str
    parts: list[tuple[str, str]]


# -- names and keys


def _uri(url: str | None, page) -> str:
    """An address without blanks, control characters or others than ASCII ones, which are escaped."""
    return f"urn:page:{page}" if url is None else urllib.parse.quote(url, safe="".join(map(chr, range(0x21, 0x7F)))) or "urn:empty"


def uri(url: str | Column, page: str | Column) -> Column:
    """The address under which a page is kept."""

    @F.pandas_udf("string")
    def named(urls, pages):
        import pandas as pd

        return pd.Series([_uri(u if isinstance(u, str) else None, p) for u, p in zip(urls, pages, strict=True)], dtype=object)

    return named(url, F.col(page).cast("string") if isinstance(page, str) else page.cast("string"))


def capture_key(address: Column) -> Column:
    """The reversed-host key of an address: `com,example,www)/path?query`. Case of the host, user names, usual ports and fragments don't count; other schemes than http stay before the key."""
    parts = lambda k: F.regexp_extract(address, r"^(?i:https?)://(?:[^/?#@]*@)?([^/?#:@]*)(:\d+)?(/[^#]*|\?[^#]*)?", k)
    host = F.lower(F.regexp_replace(parts(1), r"\.+$", ""))
    labels = F.when(host.rlike(r"^[\d.]+$"), host).otherwise(F.array_join(F.reverse(F.split(host, r"\.")), ","))
    port = F.when(parts(2).isin("", ":80", ":443"), "").otherwise(parts(2))
    path = F.when(F.startswith(parts(3), F.lit("/")), parts(3)).otherwise(F.concat(F.lit("/"), parts(3)))
    return F.when(parts(1) == "", F.lower(F.regexp_replace(address, "#.*", ""))).otherwise(F.concat(labels, port, F.lit(")"), path))


def capture_line(key: Column, number: Column) -> Column:
    """Key and number as one string that sorts as both do; null numbers come first."""
    shown = F.lpad((number.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"), 20, "0")
    return F.concat(key, F.lit(" "), F.coalesce(shown, F.lit("-")))


def base32(sha1: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1)).decode()


def record_id(page, digest: str, address: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {digest} {address}')}>"


# -- files of members


def members(data: bytes) -> list[bytes]:
    """gzip members of these bytes, each without its last byte."""
    packed = [gzip.compress(data[a : a + MEMBER], LEVEL, mtime=0) for a in range(0, max(1, len(data)), MEMBER)]
    return [p[:-1] for p in packed]


def _write(rows: DataFrame, name: str) -> str:
    """Files of the members in the column `value`; the folder. It goes when the session's process ends."""
    path = kept_path(rows.sparkSession, name)
    rows.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\x00").option("maxRecordsPerFile", 0).text(path)
    return path


@lru_cache(maxsize=64)
def _opened(path: str):
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path)
    return where.open_input_file(name)


def read_range(path: str, offset: int, length: int) -> bytes:
    """Bytes of a file of the shared folder."""
    f = _opened(path)
    f.seek(offset)
    data = f.read(length)
    if len(data) != length:
        raise OSError(f"{path} ends within {offset}+{length}")
    return data


def unpacked(data: bytes) -> bytes:
    """What all members of these bytes hold."""
    out = []
    while data:
        d = zlib.decompressobj(31)
        out.append(d.decompress(data))
        if not d.eof:
            raise ValueError("a gzip member is cut off")
        data = d.unused_data
    return out[0] if len(out) == 1 else b"".join(out)


def _walk(path: str, chunk: int = 1 << 20):
    """(offset, length, bytes) of each member of a file, read in pieces."""
    f = _opened(path)
    f.seek(0)
    at, start, held, d, out = 0, 0, b"", zlib.decompressobj(31), []
    while held or (held := f.read(chunk)):
        out.append(d.decompress(held))
        at += len(held) - len(d.unused_data)
        held = d.unused_data
        if d.eof:
            yield start, at - start, b"".join(out)
            start, d, out = at, zlib.decompressobj(31), []
    if start != at:
        raise ValueError(f"{path} ends within a member")


# -- records


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + CRLF * 2 + block + CRLF * 2


def response(page, address: str, payload: bytes, digest: str, date: str, first: tuple | None = None) -> bytes:
    """The record of a page: a response, or a revisit of `first` (page and address) whose payload is left out; its HTTP header has the payload's length either way."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "revisit" if first else "response"), ("WARC-Record-ID", record_id(page, digest, address)), ("WARC-Date", date), ("WARC-Target-URI", address)]
    headers += [] if page is None else [("X-Page-ID", str(page))]
    if first:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(first[0], digest, first[1])), ("WARC-Refers-To-Target-URI", first[1]), ("WARC-Refers-To-Date", date)]
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    return _record(headers, http if first else http + payload)


def parsed(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers, HTTP headers and payload of a record. ValueError unless it is whole."""
    end = record.find(CRLF * 2)
    lines = record[: max(0, end)].decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    if lines[0] != "WARC/1.1" or len(record) != end + 8 + int(headers["Content-Length"]) or record[-4:] != CRLF * 2:
        raise ValueError("not a whole WARC record")
    block = record[end + 4 : -4]
    if not headers["Content-Type"].startswith("application/http"):
        return headers, {}, block
    cut = block.index(CRLF * 2)
    return headers, dict(x.split(": ", 1) for x in block[:cut].decode().split("\r\n")[1:]), block[cut + 4 :]


def write(pages: DataFrame, least_bytes: int = 0, date: str = "2020-01-01T00:00:00Z") -> Archives:
    """Write a record for each page (page_id, url, html) and index them.

    Of records with equal payloads of at least `least_bytes`, that with the smallest page_id is a response, and the others revisit it; smaller ones are
    all responses. Payloads meet their digests' smallest pages in a join that Spark can split, so a payload that a third of the pages have does not
    go to one task.
    """
    spark = pages.sparkSession
    page, html = F.col("page_id").cast("long").alias("page_id"), F.coalesce("html", F.lit("")).cast("binary").alias("html")
    rows = pages.select(page, uri("url", "page_id").alias("address"), html).withColumn("sha1", F.sha1("html"))
    ids = pages.select(page, "url", html).where(F.octet_length("html") >= least_bytes).withColumn("sha1", F.sha1("html"))
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", F.coalesce("url", F.lit("\x00")).alias("url"))))
    firsts = ids.groupBy("sha1").agg(first.alias("f"), F.count("*").alias("n")).where("n > 1 and f is not null")
    firsts = firsts.select("sha1", F.col("f.page_id").alias("first"), uri(F.nullif(F.col("f.url"), F.lit("\x00")), F.col("f.page_id")).alias("first_address"))

    def run(batches):
        begun = False
        for batch in batches:
            out = [] if begun or not batch.num_rows else members(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:uuid:00000000-0000-5000-8000-000000000000>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
            begun = begun or batch.num_rows > 0
            for page, address, payload, sha1, to, to_address in zip(*(batch.column(c).to_pylist() for c in ("page_id", "address", "html", "sha1", "first", "first_address")), strict=True):
                out += members(response(page, address, payload, base32(sha1), date, None if to is None or to == page else (to, to_address)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    files = _write(rows.join(firsts, "sha1", "left").mapInArrow(lean(run), "value binary"), "warc")
    return index(spark, files)


# -- the index


def captures(spark: SparkSession, files: str) -> DataFrame:
    """address, page_id and line (JSON) of every record of the archives, read from them: a task for a file or more."""

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                out, start, size, held = [], 0, 0, b""
                for offset, length, data in _walk(path):
                    if not held:
                        start, size = offset, 0
                    held, size = held + data, size + length
                    end = held.find(CRLF * 2)
                    if len(held) < end + 8 + int(re.search(rb"\r\nContent-Length: (\d+)", held[:end])[1]):
                        continue  # the record goes on in the next member
                    headers, _, _ = parsed(held)
                    held = b""
                    if headers["WARC-Type"] == "warcinfo":
                        continue
                    page = headers.get("X-Page-ID")
                    line = {"url": headers["WARC-Target-URI"], "digest": headers["WARC-Payload-Digest"], "type": headers["WARC-Type"], "file": path.rsplit("/", 1)[1], "offset": start, "length": size}
                    out.append((headers["WARC-Target-URI"], None if page is None else int(page), json.dumps(line, separators=(",", ":"))))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], names=["address", "page_id", "line"])

    listed = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(files).select("path")
    return listed.mapInArrow(lean(run), "address string, page_id long, line string")


def index(spark: SparkSession, files: str, lines: int = LINES) -> Archives:
    """Sort the captures of archives by key and number into parts of compressed blocks, with a directory at the end of each part."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        held, directory, at = [], [], 0

        def member(data: bytes) -> pa.RecordBatch:
            nonlocal at
            packed = members(data)
            at += sum(map(len, packed)) + len(packed)
            return pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], names=["value"])

        def block():
            start = at
            out = member("\n".join(held).encode())
            directory.append((held[0], start, at - start))
            held.clear()
            return out

        for batch in batches:
            for line in batch.column("line").to_pylist():
                held.append(line)
                if len(held) == lines:
                    yield block()
        if held:
            yield block()
        if directory:
            start = at
            yield member(json.dumps(directory).encode())
            yield pa.RecordBatch.from_arrays([pa.array([trailer(start, at - start)], pa.binary())], names=["value"])

    found = captures(spark, files)
    keyed = found.select(F.concat(capture_line(capture_key(F.col("address")), F.col("page_id")), F.lit(" "), "line").alias("line"))
    path = _write(stored(keyed, "captures").repartitionByRange(n, "line").sortWithinPartitions("line").mapInArrow(lean(run), "value binary"), "capture_index")

    def first(batches):
        for batch in batches:
            some = [(directory(p)[0][0], p) for p, size in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True) if size]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in some], pa.string()) for k in (0, 1)], names=["first", "path"])

    listed = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "length")
    return Archives(files, path, sorted(map(tuple, listed.mapInArrow(first, "first string, path string").collect())))


def trailer(start: int, length: int) -> bytes:
    """A member of fixed size, less its last byte, that says where a part's directory is."""
    return gzip.compress(_TRAILER.pack(start, length), 0, mtime=0)[:-1]


def directory(path: str) -> list[tuple[str, int, int]]:
    """First line, offset and length of each block of a part of the index."""
    size, tail = _opened(path).size(), len(trailer(0, 0)) + 1
    start, length = _TRAILER.unpack(unpacked(read_range(path, size - tail, tail)))
    return [tuple(x) for x in json.loads(unpacked(read_range(path, start, length)))]


class Lookup:
    """Bisection over the parts, a part's directory and a block's lines; the last directory and block stay."""

    def __init__(self, parts: list[tuple[str, str]]):
        self.parts, self.firsts = parts, [x for x, _ in parts]
        self.directory = lru_cache(2)(self._directory)
        self.block = lru_cache(2)(lambda path, offset, length: unpacked(read_range(path, offset, length)).decode().split("\n"))

    @staticmethod
    def _directory(path: str):
        found = directory(path)
        return found, [x for x, _, _ in found]

    def lines(self, low: str, high: str):
        """All lines from low, before high, in order."""
        for p in range(max(0, bisect.bisect_left(self.firsts, low) - 1), len(self.parts)):
            if self.firsts[p] >= high:
                return
            blocks, firsts = self.directory(self.parts[p][1])
            for b in range(max(0, bisect.bisect_left(firsts, low) - 1), len(blocks)):
                if firsts[b] >= high:
                    return
                lines = self.block(self.parts[p][1], *blocks[b][1:])
                for k in range(bisect.bisect_left(lines, low), len(lines)):
                    if lines[k] >= high:
                        return
                    yield lines[k]


def locate(archives: Archives, asked: DataFrame) -> DataFrame:
    """Captures (line, and file, offset and length from it) that the rows of asked (low, high: lines from low, before high) name; equal rows give theirs once.

    Rows are sorted by ranges, so a task reads each block that it needs once, and an address that very many rows ask for (with their numbers) is dealt
    out over tasks. Nulls ask for nothing.
    """
    parts, n = archives.parts, int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        lookup, last = Lookup(parts), None
        for batch in batches:
            out = []
            for low, high in zip(batch.column("low").to_pylist(), batch.column("high").to_pylist(), strict=True):
                if (low, high) == last:
                    continue
                last = low, high
                for line in lookup.lines(low, high):
                    x = json.loads(line.split(" ", 2)[2])
                    out.append((line, x["file"], x["offset"], x["length"]))
                    if len(out) == 5000:
                        yield _located(out)
                        out = []
            yield _located(out)

    sorted_ = asked.select("low", "high").where("low is not null and high is not null").repartitionByRange(n, "low", "high").sortWithinPartitions("low", "high")
    return sorted_.mapInArrow(lean(run), "line string, file string, offset long, length long")


def _located(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("line", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], names=[x for x, _ in kinds])


def exact(line: Column) -> list[Column]:
    """Bounds of one capture, by `capture_line`."""
    return [F.concat(line, F.lit(" ")).alias("low"), F.concat(line, F.lit("!")).alias("high")]


def below(prefix: str) -> tuple[str, str]:
    """Bounds of all captures whose key begins with this: `com,example)` for a host, `com,example,` for those below it."""
    return prefix, prefix[:-1] + chr(ord(prefix[-1]) + 1)


FETCHED = "page_id long, address string, record_type string, record_id string, refers_to_id string, payload_bytes long, payload_digest string, payload binary"


def fetch(archives: Archives, located: DataFrame, payloads: bool = True) -> DataFrame:
    """The records at located places, read by ranges: FETCHED. A response's length and digest are its payload's, and have to agree with its headers; a revisit's are those it states.

    Places are sorted by ranges; neighbours are read at once, READ bytes or one record at a time.
    """
    folder, n = archives.files, int(located.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def rows(held):
        start, end = held[0][1], max(o + size for _, o, size in held)
        data = read_range(f"{folder}/{held[0][0]}", start, end - start)
        for _, offset, length in held:
            headers, http, payload = parsed(unpacked(data[offset - start : offset - start + length]))
            page, kind, digest, size = headers.get("X-Page-ID"), headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(http["Content-Length"])
            if kind == "response" and (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()) != (size, digest):
                raise ValueError("a payload is not what its header says")
            yield None if page is None else int(page), headers["WARC-Target-URI"], kind, headers["WARC-Record-ID"], headers.get("WARC-Refers-To"), size, digest, payload if payloads and kind == "response" else None

    def run(batches):
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
        names = [x.split(" ")[0] for x in FETCHED.split(", ")]

        def made(held):
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows(held), strict=True), kinds, strict=True)], names=names)

        held: list[tuple[str, int, int]] = []
        for batch in batches:
            for place in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if held and (place[0] != held[-1][0] or place[1] > held[-1][1] + held[-1][2] + GAP or place[1] + place[2] - held[0][1] > READ):
                    yield made(held)
                    held = []
                held.append(place)
        if held:
            yield made(held)

    sorted_ = located.select("file", "offset", "length").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    return sorted_.mapInArrow(lean(run), FETCHED)


def report(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each page, from archives written and read back: every page is looked up in the index by its address and number.

    Revisits are resolved: they meet the response they refer to by its record's name, and take length and digest from its payload.
    """
    archives = write(pages)
    line = capture_line(capture_key(uri("url", "page_id")), F.col("page_id").cast("long"))
    found = stored(fetch(archives, locate(archives, pages.select(*exact(line))), payloads=False).drop("payload"), "fetched")
    own = found.where("record_type = 'response'")
    first = own.groupBy(F.col("record_id").alias("refers_to_id")).agg(*(F.min(c).alias(c) for c in ("page_id", "payload_bytes", "payload_digest")))
    others = found.where("record_type = 'revisit'").select(F.col("page_id").alias("visit"), "refers_to_id").join(first, "refers_to_id", "left")
    return own.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).union(
        others.select("visit", "payload_bytes", "payload_digest", F.lit("revisit"), "page_id")
    )
