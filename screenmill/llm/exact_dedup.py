"""Exact deduplication with counting quotient filters.

Each partition builds a counting quotient filter of its texts' 64-bit fingerprints: the high bits (the quotient) are
places, the rest (the remainder) is stored, sorted within its place, with a count.  The filter is cut by its highest
bits into shards; a shard's filters from all partitions merge without loss, because their remainders are sorted.
Fingerprints with a count above one go to byte verification: only their texts are shuffled, and a text's bytes are the
key of the group, with copies combined in each partition before the shuffle.

Rows: a null text counts as empty, and empty texts equal each other; every row yields one row, so a repeated row (same
doc_id and text) appears as often as it came; null doc_ids lose against any other, and if all ids of a group are null,
keep_id is null and every row of it is kept; other columns are ignored; an empty table yields an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, keyed_texts, release, settled, sized

#: Fingerprints that a shard of the merge gets, on average; and groups that may be hot (each with that share of all rows).
SHARD_FINGERPRINTS, HOT_GROUPS = 1 << 20, 1000


class QuotientFilter:
    """Multiset of 64-bit fingerprints: runs of sorted remainders by quotient, and counts."""

    def __init__(self, quotient_bits: int, places: np.ndarray, sizes: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.quotient_bits, self.places, self.sizes, self.remainders, self.counts = quotient_bits, places, sizes, remainders, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray, quotient_bits: int) -> QuotientFilter:
        order = np.argsort(fingerprints)
        return cls.sorted_run(*summed_run(fingerprints[order], counts[order]), quotient_bits)

    @classmethod
    def sorted_run(cls, sorted_: np.ndarray, total: np.ndarray, quotient_bits: int) -> QuotientFilter:
        rest = np.uint64(64 - quotient_bits)
        places, sizes = np.unique((sorted_ >> rest).astype(np.uint32), return_counts=True)
        return cls(quotient_bits, places, sizes.astype(np.uint32), sorted_ & ((np.uint64(1) << rest) - np.uint64(1)), total.astype(np.uint32))

    def fingerprints(self) -> np.ndarray:
        return (np.repeat(self.places, self.sizes).astype(np.uint64) << np.uint64(64 - self.quotient_bits)) | self.remainders

    @classmethod
    def merged(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        """Lossless: every fingerprint keeps the sum of its counts.  Two by two, by the order that both already have."""
        bits = filters[0].quotient_bits
        runs = [(f.fingerprints(), f.counts.astype(np.int64)) for f in filters]
        while len(runs) > 1:
            runs = [merged_runs(*runs[k], *runs[k + 1]) if k + 1 < len(runs) else runs[k] for k in range(0, len(runs), 2)]
        return cls.sorted_run(*runs[0], bits)

    def shards(self, bits: int) -> Iterator[tuple[int, QuotientFilter]]:
        """The parts whose quotients share their highest bits."""
        owner = self.places >> np.uint32(self.quotient_bits - bits)
        slots = np.r_[0, np.cumsum(self.sizes.astype(np.int64))]
        for shard in np.unique(owner).tolist():
            a, b = np.searchsorted(owner, [shard, shard + 1])
            part = slice(int(slots[a]), int(slots[b]))
            yield shard, QuotientFilter(self.quotient_bits, self.places[a:b], self.sizes[a:b], self.remainders[part], self.counts[part])

    def to_bytes(self) -> bytes:
        head = np.array([self.quotient_bits, len(self.places), len(self.remainders)], np.uint32)
        return b"".join(x.tobytes() for x in (head, self.places, self.sizes, self.counts, self.remainders))

    @classmethod
    def from_bytes(cls, data: bytes) -> QuotientFilter:
        bits, n, m = np.frombuffer(data, np.uint32, 3).tolist()
        at = 12
        parts = []
        for size, kind in ((n, np.uint32), (n, np.uint32), (m, np.uint32), (m, np.uint64)):
            parts.append(np.frombuffer(data, kind, size, at))
            at += size * np.dtype(kind).itemsize
        return cls(bits, parts[0], parts[1], parts[3], parts[2])


def summed_run(fingerprints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sorted run with equal fingerprints made one."""
    if not len(fingerprints):
        return fingerprints, counts
    first = np.flatnonzero(np.r_[True, fingerprints[1:] != fingerprints[:-1]])
    return fingerprints[first], np.add.reduceat(counts, first)


def merged_runs(a: np.ndarray, a_counts: np.ndarray, b: np.ndarray, b_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(a, b)
    return summed_run(np.insert(a, at, b), np.insert(a_counts, at, b_counts))


def repeated_fingerprints(fingerprints: DataFrame, rows: int, quotient_bits: int = 24) -> DataFrame:
    """fp of all fingerprints that occur more than once in the column fp; rows: how many there are, which sets the number of shards."""
    shard_bits = min(quotient_bits - 4, max(8, (rows // SHARD_FINGERPRINTS).bit_length()))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: QuotientFilter | None = None
        waiting: list[np.ndarray] = []

        def added() -> QuotientFilter:
            fresh = np.concatenate(waiting)
            waiting.clear()
            new = QuotientFilter.of(fresh, np.ones(len(fresh), np.int64), quotient_bits)
            return QuotientFilter.merged([own, new]) if own else new

        for batch in batches:
            waiting.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            if sum(map(len, waiting)) > 1 << 20:
                own = added()
        if waiting:
            own = added()
        release()
        if own:
            parts = list(own.shards(shard_bits))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in parts], pa.int32()), pa.array([f.to_bytes() for _, f in parts], pa.binary())], ["shard", "filter"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        whole = QuotientFilter.merged([QuotientFilter.from_bytes(x) for x in rows["filter"]])
        return pd.DataFrame({"fp": whole.fingerprints()[whole.counts > 1].view(np.int64)})

    return fingerprints.select("fp").mapInArrow(build, "shard int, filter binary").groupBy("shard").applyInPandas(merge, "fp long")


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; of equal texts the largest doc_id stays."""
    return exact_rows(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def exact_rows(docs: DataFrame) -> DataFrame:
    """The same with text_hash, the xxhash64 of the row's text."""
    texts = keyed_texts(docs)
    marked = texts.withColumn("fp", F.xxhash64("text"))
    n = docs.count()
    # counted first: a short list is broadcast, so that only texts that may have a copy are shuffled
    repeated = sized(repeated_fingerprints(marked, n))
    # byte verification: the text itself is the key, so equal fingerprints of different texts part here
    groups = settled(
        marked.join(repeated, "fp", "left_semi")
        .groupBy("text")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
        .select(F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"),
        "exact-groups",
    )
    rows = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), F.sha2("text", 256).alias("text_sha256"))
    if groups.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(groups), "text_sha256", "left")
    else:
        # groups with more than this share of the rows are HOT_GROUPS at most, so they are broadcast; the others are shuffled
        hot = F.broadcast(groups.filter(F.col("group_size") * HOT_GROUPS > n))
        joined = rows.join(hot, "text_sha256").unionByName(rows.join(hot, "text_sha256", "left_anti").join(groups, "text_sha256", "left"))
    return joined.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), True).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
        "text_hash",
    )


EXACT_SQL = """
WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, t.text_sha256
FROM t JOIN g ON t.text = g.text
"""
