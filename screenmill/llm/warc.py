"""WARC archives of pages, with a two-level index of captures.

Writing: each task writes archives of its own pages, every record a gzip member of its own, and returns where each record
lies.  Of equal payloads one record has the content and the others revisit it.  Only archives and places that a finished
task has returned are ever read, so what a lost attempt has written is named by nothing.

Index: captures sorted by key (the host's labels reversed, then path and query) are range-partitioned into parts.  A part
is a file of compressed blocks of BLOCK_LINES lines, followed by its sparse directory, a line with the first key of each
block.  The parts' first keys are a list of MOST_PARTS entries at most.

Look-up: keys are searched by bisection in the list of parts, then in the directory of their part, then in the block that
may hold them; each step is dealt anew, by part, by block and by place in the archives, so that a key with any number of
captures is dealt over its blocks.  Records are then read by ranges, neighbours together.

Files are reached through pyarrow's file systems (local and shared folders, HDFS, object stores), in the tasks alone.

Rows: a null html is an empty payload; a null URL has the key "" and the record's target `urn:page:` with the page_id;
white space and control characters of URLs are percent-encoded in records and keys; every row is a record, so repeated
rows are found as often as they came.  Of equal payloads all rows with the smallest page_id are responses (one, unless a
page_id is repeated); a null page_id revisits any other, and if all ids are null, all are responses.  Other columns are
ignored; an empty table yields empty tables.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import grouped_left, release, settled, work_folder
from .url_filter import host_of

#: Bytes of an archive after which a task begins another, and of records that are read at once.
ARCHIVE_BYTES, READ_BYTES = 1 << 30, 1 << 22
#: Lines of a block of the index, captures of a part, and most parts; keys in directories are cut to so many characters.
BLOCK_LINES, PART_CAPTURES, MOST_PARTS, KEY_CHARS = 3000, 1 << 17, 20_000, 200
#: Rows of a batch that a task returns, and bytes of payload in it.
BATCH_ROWS, BATCH_BYTES = 4096, 1 << 22

CAPTURE = "key string, page_id long, file string, offset long, length long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, intact boolean, payload binary"
STAMP = "2020-01-01T00:00:00Z"


def storage(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path in it."""
    path = re.sub(r"^file:/+", "/", path)
    path = re.sub(r"^s3[an]:", "s3:", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def key_of(url: Column) -> Column:
    """`com,example)/path?query` of https://user@Example.com:80/path?query#part; other texts are their own key, null is ""."""
    host = host_of(url)
    after = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    key = F.when(host == "", url).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), after))
    return F.coalesce(F.regexp_replace(key, r"[\x00-\x20\x7f]", "%20"), F.lit(""))


def packed(data: bytes) -> bytes:
    """A gzip member."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def unpacked(data: bytes) -> bytes:
    return zlib.decompress(data, 31)


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def headers(first: str, fields: list[tuple[str, object]]) -> bytes:
    return "".join([first, "\r\n", *(f"{k}: {v}\r\n" for k, v in fields if v is not None), "\r\n"]).encode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'urn:page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """The bytes of a response, or of a revisit if refers_to is given: the same without its payload."""
    digest = sha1(payload)
    block = headers("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))])
    block += b"" if refers_to is not None else payload
    target = f"urn:page:{page_id}" if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    fields: list[tuple[str, object]] = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Target-URI", target),
        ("WARC-Date", STAMP),
        ("WARC-Page-ID", page_id),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{sha1(block)}"),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-Refers-To-Page-ID", refers_to)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return headers("WARC/1.1", fields) + block + b"\r\n\r\n"


def fields_of(head: bytes) -> dict[str, str]:
    """The fields of a record's or a response's head by lower-case name."""
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip(" \t") for k, _, v in pairs}


def parsed(data: bytes) -> dict | None:
    """A row of RECORD from a record's bytes; None for records of other types."""
    head, _, rest = data.partition(b"\r\n\r\n")
    own = fields_of(head)
    if own.get("warc-type") not in ("response", "revisit"):
        return None
    block = rest[: int(own["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    digest = own.get("warc-payload-digest", "").removeprefix("sha1:")
    number = lambda name: int(own[name]) if own.get(name, "").lstrip("-").isdigit() else None
    row = {"page_id": number("warc-page-id"), "url": own.get("warc-target-uri"), "record_type": own["warc-type"], "refers_to": number("warc-refers-to-page-id")}
    if row["url"] == f"urn:page:{row['page_id']}":
        row["url"] = None
    whole = own.get("warc-block-digest", f"sha1:{sha1(block)}") == f"sha1:{sha1(block)}"
    if row["record_type"] == "revisit":
        size = fields_of(http).get("content-length", "")
        return row | {"payload_bytes": int(size) if size.isdigit() else None, "payload_digest": digest or None, "intact": whole, "payload": None}
    found = sha1(body)
    return row | {"payload_bytes": len(body), "payload_digest": found, "intact": whole and digest in ("", found), "payload": body}


def batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches that are bounded by rows and bytes of payload."""
    held: list[dict] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row.get("payload") or b"")
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)
    release()


CAPTURE_ARROW = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
RECORD_ARROW = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_()), ("payload", pa.binary())]
)


class Appended:
    """A file that grows: write() returns where the bytes begin."""

    def __init__(self, path: str):
        system, at = storage(path)
        system.create_dir(at.rpartition("/")[0], recursive=True)
        self.file, self.size = system.open_output_stream(at, compression=None), 0

    def write(self, data: bytes) -> int:
        self.file.write(data)
        self.size += len(data)
        return self.size - len(data)


def attempt_name(what: str) -> str:
    """A name that no other attempt of any task has."""
    from pyspark import TaskContext

    task = TaskContext.get()
    return f"{what}-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write a record for each page (page_id, url, html) to archives below folder; returns the captures.

    Payloads of at least least_bytes that are equal are stored once; smaller ones are all responses.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    marked = rows.withColumn("digest", F.unhex(F.sha2("html", 256)))
    large = marked.filter(F.octet_length("html") >= least_bytes)
    groups = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("size")).filter("size > 1 AND first IS NOT NULL")
    met = grouped_left(marked, settled(groups, "warc-copies", 64), "digest", pages.count())
    # the response of a group is the row, or the rows, with its smallest page_id
    refers_to = F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first"))
    ready = met.select(key_of(F.col("url")).alias("key"), "page_id", "url", F.col("html").cast("binary").alias("html"), refers_to.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def captures() -> Iterator[dict]:
            out, name = None, ""
            for batch in batches:
                for k in range(batch.num_rows):
                    key, page_id, url, html, first = (c[k].as_py() for c in batch.columns)
                    if out is None or out.size > ARCHIVE_BYTES:
                        if out:
                            out.file.close()
                        name = attempt_name("pages") + ".warc.gz"
                        out = Appended(f"{folder}/{name}")
                        info = b"software: screenmill\r\nformat: WARC File Format 1.1\r\n"
                        out.write(packed(headers("WARC/1.1", [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", STAMP), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", len(info))]) + info + b"\r\n\r\n"))
                    member = packed(record(page_id, url, html, first))
                    yield {"key": key, "page_id": page_id, "file": name, "offset": out.write(member), "length": len(member)}
            if out:
                out.file.close()

        yield from batched(captures(), CAPTURE_ARROW)

    return settled(ready.mapInArrow(write, CAPTURE), "warc-captures")


def scan_archives(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the archives below folder, read from end to end without an index: the rows of RECORD."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(folder).select("path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    for data in members(path):
                        if row := parsed(data):
                            yield row

        yield from batched(rows(), RECORD_ARROW)

    return files.mapInArrow(read, RECORD)


def members(path: str) -> Iterator[bytes]:
    """The gzip members of a file, one after another; one is held at a time."""
    system, at = storage(path)
    with system.open_input_file(at) as file:
        z, held = zlib.decompressobj(31), []
        while data := file.read(1 << 20):
            while data:
                held.append(z.decompress(data))
                data = z.unused_data
                if not z.eof:
                    break
                yield b"".join(held)
                z, held = zlib.decompressobj(31), []


class Index:
    """Two levels below folder: parts (number, file, place of the directory, first key), a row for each, and their files."""

    def __init__(self, folder: str, parts: list[tuple[str, int, int, str]]):
        self.folder, self.parts = folder, sorted(parts, key=lambda p: p[0])


def build_index(captures: DataFrame, folder: str) -> Index:
    """Sort the captures by key into parts of compressed blocks, each with its directory at its end."""
    n_parts = max(1, min(MOST_PARTS, -(-captures.count() // PART_CAPTURES)))
    by = ["key", "page_id", "file", "offset"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = attempt_name("index") + ".cdx.gz"
        out, lines, blocks, first = None, [], [], None

        def closed() -> None:
            data = packed("".join(lines).encode())
            blocks.append(f"{lines[0].partition(' ')[0][:KEY_CHARS]} {out.write(data)} {len(data)}\n")
            lines.clear()

        for batch in batches:
            for key, page_id, file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out, first = Appended(f"{folder}/{name}"), key[:KEY_CHARS]
                lines.append(f"{key} {'-' if page_id is None else page_id} {file} {offset} {length}\n")
                if len(lines) == BLOCK_LINES:
                    closed()
        if out:
            if lines:
                closed()
            directory = packed("".join(blocks).encode())
            place = out.write(directory)
            out.file.close()
            release()
            yield pa.RecordBatch.from_pydict({"file": [name], "offset": pa.array([place], pa.int64()), "length": pa.array([len(directory)], pa.int64()), "first": [first]})

    ranged = captures.select("key", "page_id", "file", "offset", "length").repartitionByRange(n_parts, *by).sortWithinPartitions(*by)
    parts = settled(ranged.mapInArrow(write, "file string, offset long, length long, first string"), "warc-parts").collect()
    # names begin with the number of the range, so their order is that of the keys
    return Index(folder, [tuple(p) for p in parts])


def read_range(opened: dict, path: str, offset: int, length: int) -> bytes:
    """Bytes of a file; opened holds the one that was read last."""
    if path not in opened:
        for file in opened.values():
            file.close()
        opened.clear()
        system, at = storage(path)
        opened[path] = system.open_input_file(at)
    return opened[path].read_at(length, offset)


def candidates(firsts: list[str], key: str) -> range:
    """Entries of a sorted directory that may hold the key; both are cut to KEY_CHARS, so this may be one more than needed."""
    key = key[:KEY_CHARS]
    return range(max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key))


def locate(index: Index, keys: DataFrame) -> DataFrame:
    """The captures whose key is among the keys (column key; repeated ones count once)."""
    folder, parts = index.folder, index.parts
    firsts = [p[3] for p in parts]

    def to_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(key, part) for key in batch.column(0).to_pylist() for part in candidates(firsts, key)]
            yield pa.RecordBatch.from_pydict({"key": pa.array([k for k, _ in found], pa.string()), "part": pa.array([p for _, p in found], pa.int32())})

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, held, starts, places = {}, None, [], []
        for batch in batches:
            out = []
            for key, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != held:
                    file, offset, length, _ = parts[part]
                    lines = unpacked(read_range(opened, f"{folder}/{file}", offset, length)).decode().split("\n")[:-1]
                    held, entries = part, [x.split(" ") for x in lines]
                    starts, places = [e[0] for e in entries], [(int(e[1]), int(e[2])) for e in entries]
                out += [(key, part, *places[k]) for k in candidates(starts, key)]
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["key", "part", "offset", "length"])

    def to_captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            opened, held, lines, own = {}, None, [], []
            for batch in batches:
                for key, part, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (part, offset) != held:
                        held, lines = (part, offset), unpacked(read_range(opened, f"{folder}/{parts[part][0]}", offset, length)).decode().split("\n")[:-1]
                        own = [x.partition(" ")[0] for x in lines]
                    for k in range(bisect_left(own, key), bisect_right(own, key)):
                        _, page_id, file, at, size = lines[k].split(" ")
                        yield {"key": key, "page_id": None if page_id == "-" else int(page_id), "file": file, "offset": int(at), "length": int(size)}

        yield from batched(rows(), CAPTURE_ARROW)

    asked = keys.select("key").distinct().mapInArrow(to_parts, "key string, part int")
    dealt = asked.repartition("part", F.pmod(F.xxhash64("key"), F.lit(16))).sortWithinPartitions("part", "key")
    blocks = dealt.mapInArrow(to_blocks, "key string, part int, offset long, length long")
    return blocks.repartition("part", "offset").sortWithinPartitions("part", "offset", "key").mapInArrow(to_captures, CAPTURE)


def fetch(captures: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records at the places of the captures, read by ranges; without payloads that column is null."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            opened: dict = {}
            for batch in batches:
                places = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
                k = 0
                while k < len(places):
                    # neighbours are read together
                    file, low, size = places[k]
                    end, last = low + size, k + 1
                    while last < len(places) and places[last][:2] == (file, end) and end - low < READ_BYTES:
                        end, last = end + places[last][2], last + 1
                    data = memoryview(read_range(opened, f"{folder}/{file}", low, end - low))
                    for _, at, length in places[k:last]:
                        if row := parsed(unpacked(data[at - low : at - low + length])):
                            yield row if payloads else row | {"payload": None}
                    k = last

        yield from batched(rows(), RECORD_ARROW)

    near = captures.select("file", "offset", "length").repartition("file", F.shiftright("offset", 24)).sortWithinPartitions("file", "offset")
    return near.mapInArrow(read, RECORD)


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the pages to archives, index them, look all their URLs up and read the records back."""
    folder = work_folder(pages.sparkSession, "warc")
    captures = write_archives(pages, folder, least_bytes)
    index = build_index(captures, f"{folder}-index")
    keys = pages.select(key_of(F.col("url").cast("string")).alias("key"))
    return fetch(locate(index, keys), folder, payloads=False)


WARC_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, min(page_id) AS first, sha1(html) AS h FROM p GROUP BY html),
b AS (SELECT *, array_to_string(list_transform(range(8), lambda k: array_to_string(list_transform([15, 10, 5, 0], lambda s:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || h[k * 5 + 1 : k * 5 + 5])::BIGINT >> s) & 31)::INT + 1]), '')), '') AS payload_digest FROM g)
SELECT page_id, strlen(p.html) AS payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p JOIN b ON p.html = b.html
"""
