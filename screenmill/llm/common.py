"""Helpers shared by the operators of this subpackage: text columns, word hashes, working folders."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_PRIME = 0x5851F42D4C957F2D
_MASK64 = (1 << 64) - 1

#: Arrow batches are worked on in pieces of about so many bytes of text, whatever the rows' lengths.
PIECE_BYTES = 1 << 19


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(name: str = "text") -> Column:
    """The text column as string; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def columns_of(df: DataFrame) -> list[Column]:
    """All columns by their names, whatever characters those have."""
    return [F.col("`" + c.replace("`", "``") + "`").alias(c) for c in df.columns]


def keyed_texts(docs: DataFrame) -> DataFrame:
    """doc_id and whole text alone: extra or clashing columns never reach the operators."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and text: rows with one doc_id and different texts are told apart by the hash."""
    return keyed_texts(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


def work_folder(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        top = tempfile.mkdtemp(prefix="spark-")  # driver and executors are one process
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"


#: For tables whose rows are megabytes: a row group is closed by its size, not after a hundred rows, and isn't held as a dictionary.
BLOCK_ROWS = {"parquet.block.size": 1 << 23, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": "false"}
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def settled(df: DataFrame, what: str, tasks: int | None = None, blocks: bool = False) -> DataFrame:
    """The rows written to a table in the shared folder and read again: later steps start from it.

    tasks: most tasks, and so files, of the last stage; for tables whose rows are few beside the shuffle partitions.
    blocks: the rows are packed blocks.
    """
    spark = df.sparkSession
    path = work_folder(spark, what)
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, "8m")  # what JVM and Python hold of a batch at once
    try:
        (df.coalesce(tasks) if tasks else df).write.options(**(BLOCK_ROWS if blocks else {})).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(BATCH_BYTES)
        else:
            spark.conf.set(BATCH_BYTES, before)
    return spark.read.schema(df.schema).parquet(path)


def rested(spark: SparkSession) -> None:
    """Have the executors collect their garbage.

    A heap that one operator has filled is only given back after a full collection; until then it takes the memory that
    the next operator's Python workers need.  A task for each core reaches every executor that has any.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


#: A list of ids is broadcast up to so many rows (about 100 MB); beyond that Spark shuffles both sides.
BROADCAST_ROWS = 2_000_000


def sized(ids: DataFrame) -> DataFrame:
    """A narrow table, written and counted, and marked for broadcast if its rows are few enough; no executor holds it."""
    ids = settled(ids, "ids", 64)
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


#: Groups that may be hot: those with more than this share of all rows are no more than so many.
HOT_GROUPS = 1000
#: Rows of a list of groups (a key of 32 bytes and a few numbers each) that are broadcast: about 40 MB.
BROADCAST_GROUPS = 400_000


def grouped_left(rows: DataFrame, groups: DataFrame, key: str, total: int) -> DataFrame:
    """rows left join groups (a written table: key, size, ...; a row for each key), where a key may have a third of all rows.

    A short list is broadcast.  Beyond that the hot groups are, of which there are HOT_GROUPS at most, and the rest is shuffled.
    """
    if groups.count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), key, "left")
    hot = F.broadcast(groups.filter(F.col("size") * HOT_GROUPS > total))
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups, key, "left")
    return rows.join(hot, key).unionByName(cold)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, about: int | None = None) -> DataFrame:
    """mapInArrow with a function that make() builds once in each task; about: bytes of a piece, PIECE_BYTES if not given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        try:
            for batch in batches:
                for piece in pieces(batch, about):
                    yield work(piece)
        finally:
            release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Give memory that a task has freed back to the system: a Python worker is used again, by other operators too."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library than glibc


def grouped_arrow(rows: DataFrame, key: str, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """groupBy(key).applyInArrow(work) whose tasks give their memory back."""

    def run(table: pa.Table) -> pa.Table:
        try:
            return work(table)
        finally:
            release()

    return rows.groupBy(key).applyInArrow(run, schema)


def met_arrow(left: DataFrame, right: DataFrame, key: str, work: Callable[[tuple, pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """The groups of both tables by the key, met by cogroup().applyInArrow(work), whose tasks give their memory back."""

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        try:
            return work(key, a, b)
        finally:
            release()

    return left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(run, schema)


def gathered(batches: Iterator[pa.RecordBatch], most_bytes: int, most_rows: int = 1 << 16) -> Iterator[pa.Table]:
    """The rows of a task in tables of about most_bytes and most_rows at most; a row is never cut."""
    held: list[pa.RecordBatch] = []
    size = rows = 0
    for batch in batches:
        for piece in pieces(batch):
            for at in range(0, piece.num_rows, most_rows):
                part = piece.slice(at, most_rows)
                if held and (size + part.nbytes > most_bytes or rows + part.num_rows > most_rows):
                    yield pa.Table.from_batches(held)
                    held, size, rows = [], 0, 0
                held.append(part)
                size, rows = size + part.nbytes, rows + part.num_rows
    if held:
        yield pa.Table.from_batches(held)


def zipped(table: pa.Table) -> bytes:
    """A table as compressed bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def unzipped(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def block_number(nth: int) -> int:
    """A number for the nth block of this task, unlike those of all others of the job."""
    from pyspark import TaskContext

    return (TaskContext.get().partitionId() << 32) | nth


def planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte of equal weight, so that the high ones, mostly 0, compress to nothing."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()


def from_planes(data: bytes, kind: str, n: int, at: int = 0) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T).view(kind).reshape(n)


def pieces(batch: pa.RecordBatch, about: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batch cut by rows into slices of about so many bytes, PIECE_BYTES if not given."""
    n = batch.num_rows
    if n == 0:
        return
    step = max(1, int(n * (about or PIECE_BYTES) / max(batch.nbytes, 1)))
    for at in range(0, n, step):
        yield batch.slice(at, step)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column without nulls, and the row boundaries in them."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    low, high = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8, high - low, low) if high > low else np.zeros(0, np.uint8)
    return raw, offsets - low


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(_PRIME, -1, 1 << 64)
        _POWERS[:] = [np.cumprod(np.array([1] + [b] * (size - 1), np.uint64)) for b in (_PRIME, inverse)]
    return _POWERS[0][:n], _POWERS[1][:n]


def _word_byte_table() -> np.ndarray:
    """Byte to its value in a word: letters in lower case, digits and all bytes over 127 as they are, 0 for the rest."""
    t = np.zeros(256, np.uint8)
    t[128:] = np.arange(128, 256)
    for low, high, add in ((48, 58, 0), (97, 123, 0), (65, 91, 32)):
        t[low:high] = np.arange(low, high) + add
    return t


WORD_BYTES = _word_byte_table()


class Words:
    """The words (runs of letters and digits, ASCII case folded, other characters kept) of all rows of a batch.

    starts, ends: byte places; rows: boundaries of the rows in them.  A span's hash is a polynomial over its bytes, a
    difference of running sums, so that no loop over words is needed.
    """

    def __init__(self, raw: np.ndarray, bounds: np.ndarray):
        n = len(raw)
        low = WORD_BYTES[raw]
        inside = low > 0
        edge = inside.copy()
        edge[1:] &= ~inside[:-1]
        fresh = bounds[:-1][bounds[:-1] < n]
        edge[fresh] = inside[fresh]
        close = inside.copy()
        close[:-1] &= ~inside[1:] | edge[1:]
        self.starts = np.flatnonzero(edge)
        self.ends = np.flatnonzero(close) + 1
        self.rows = np.searchsorted(self.starts, bounds)
        power, self.inverse = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(low * power[:n], out=self.sums[1:])

        self.raw = raw

    def hashes(self, first: int | None = None) -> np.ndarray:
        """Of the words, or of their first characters only."""
        ends = self.ends
        if first is not None and len(self.starts):
            letters = np.append(np.flatnonzero((self.raw & 0xC0) != 0x80), len(self.raw))
            after = np.searchsorted(letters, self.starts, "right") + first - 1
            ends = np.minimum(letters[np.minimum(after, len(letters) - 1)], ends)
        return mix64((self.sums[ends] - self.sums[self.starts]) * self.inverse[self.starts] + (ends - self.starts).astype(np.uint64) * _GOLD)
