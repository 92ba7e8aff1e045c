"""Tables in hash buckets with a manifest: changes are written as deltas to the buckets that they touch, and compacted.

A table is a folder of data folders, each with a folder for every bucket that it has rows of, and of manifests: the list
of data folders of each bucket.  A change writes one data folder and the next manifest; a manifest that is there already
stops it, so of two writers one fails and begins anew.  A row's bucket is a hash of its key, so a change reads nothing,
and a look-up of keys reads their buckets alone.  Where a key is in several data folders of its bucket, the one written
last decides.  Compaction rewrites only buckets with more data folders than it is told to leave, so the number of files
is bounded by buckets times that.

A table is `keyed` (a key is one row, an upsert replaces it) or not (a key is a group of rows, which are replaced together).
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Names beside those of the table's columns.
BUCKET, VERSION, GONE = "_bucket", "_version", "_gone"
#: A look-up of so many keys at most is a filter, too.
FEW_KEYS = 500


class BucketTable:
    """The newest state of the table at path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        facts = spark.read.json(f"{self.path}/facts").first()
        self.keys, self.n, self.keyed, self.keep, self.schema = list(facts["keys"]), facts["buckets"], facts["keyed"], list(facts["keep"]), StructType.fromJson(json.loads(facts["schema"]))
        self.bloom = facts["bloom"]

    @classmethod
    def create(cls, rows: DataFrame, path: str, keys: list[str], buckets: int = 64, keyed: bool = True, keep: tuple[str, ...] = (), bloom: str = "") -> BucketTable:
        """A table of the rows.  keep: columns that an upserted row retains; bloom: a column whose files get Bloom filters."""
        table = cls.empty(rows, path, keys, buckets, keyed, keep, bloom)
        table.write(rows)
        return table

    @classmethod
    def empty(cls, like: DataFrame, path: str, keys: list[str], buckets: int = 64, keyed: bool = True, keep: tuple[str, ...] = (), bloom: str = "") -> BucketTable:
        """A table without rows, with the columns of like."""
        spark = like.sparkSession
        facts = [(keys, buckets, keyed, list(keep), like.schema.json(), bloom)]
        spark.createDataFrame(facts, "keys array<string>, buckets int, keyed boolean, keep array<string>, schema string, bloom string").coalesce(1).write.json(f"{path.rstrip('/')}/facts")
        spark.createDataFrame([], "bucket int, folder string, version long").coalesce(1).write.parquet(f"{path.rstrip('/')}/manifests/0")
        return cls(spark, path)

    @classmethod
    def opened(cls, like: DataFrame, path: str, keys: list[str], **facts) -> BucketTable:
        """The table at path; if there is none, an empty one with the columns of like."""
        try:
            return cls(like.sparkSession, path)
        except AnalysisException:
            return cls.empty(like, path, keys, **facts)

    def versions(self) -> list[int]:
        """Those whose manifest is written: its one file shows when it is whole."""
        found = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(f"{self.path}/manifests")
        return sorted(int(r.path.rstrip("/").split("/")[-2]) for r in found.select("path").collect())

    def manifest(self) -> tuple[int, list[tuple[int, str, int]]]:
        """The newest version, and (bucket, folder, version of the folder) of all buckets: a few rows for each."""
        newest = self.versions()[-1]
        return newest, sorted(tuple(r) for r in self.spark.read.schema("bucket int, folder string, version long").parquet(f"{self.path}/manifests/{newest}").collect())

    def bucket_of(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.n)).cast("int")

    def commit(self, newest: int, entries: list[tuple[int, str, int]]) -> None:
        self.spark.createDataFrame(entries, "bucket int, folder string, version long").coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/manifests/{newest + 1}")

    def put(self, rows: DataFrame, version: Column) -> tuple[str, list[int]]:
        """Write rows of the table's columns and GONE to a new data folder; its name and buckets."""
        folder = uuid.uuid4().hex
        # rebalanced, so that a bucket with a hot key is several files and small ones are one
        dealt = rows.withColumn(VERSION, version).withColumn(BUCKET, self.bucket_of()).hint("rebalance", BUCKET)
        writer = dealt.write.partitionBy(BUCKET)
        if self.bloom:
            writer = writer.option(f"parquet.bloom.filter.enabled#{self.bloom}", "true")
        writer.parquet(f"{self.path}/data/{folder}")
        # names of folders only: no file is read
        made = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{self.path}/data/{folder}")
        names = made.select(F.regexp_extract("path", rf"/{BUCKET}=(\d+)/", 1).alias("b")).filter("b <> ''").distinct().collect()
        return folder, sorted(int(r.b) for r in names)

    def write(self, rows: DataFrame) -> int:
        """Upsert the rows, or replace the groups of their keys; returns the number of buckets touched."""
        return self.change(rows.select(*self.schema.names, F.lit(False).alias(GONE)))

    def delete(self, keys: DataFrame) -> int:
        """Delete rows, or groups, by their keys."""
        gone = keys.select(*self.keys).distinct()
        return self.change(gone.select(*(F.col(f.name) if f.name in self.keys else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields), F.lit(True).alias(GONE)))

    def change(self, rows: DataFrame) -> int:
        newest, entries = self.manifest()
        folder, touched = self.put(rows, F.lit(newest + 1).cast("long"))
        self.commit(newest, entries + [(b, folder, newest + 1) for b in touched])
        return len(touched)

    def stored(self, entries: list[tuple[int, str, int]]) -> DataFrame:
        """All rows of the data folders, with VERSION and GONE."""
        schema = StructType([*self.schema.fields]).add(GONE, "boolean").add(VERSION, "long")
        paths = [f"{self.path}/data/{folder}/{BUCKET}={b}" for b, folder, _ in entries]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def settled(self, rows: DataFrame) -> DataFrame:
        """Of each key what was written last."""
        if self.keyed:
            rest = [c for c in self.schema.names if c not in self.keys and c not in self.keep]
            # a kept column is that of the oldest row since the last deletion
            last = F.max_by(F.struct(*rest, GONE, VERSION), VERSION).alias("r")
            if not self.keep:
                return rows.groupBy(*self.keys).agg(last).select(*self.keys, "r.*")
            gone = rows.groupBy(*self.keys).agg(last, F.max(F.when(F.col(GONE), F.col(VERSION))).alias("cut"), *(F.collect_list(F.when(~F.col(GONE) & F.col(c).isNotNull(), F.struct(VERSION, F.col(c).alias("v")))).alias(f"_{c}") for c in self.keep))
            oldest = lambda c: F.array_min(F.filter(f"_{c}", lambda x: F.col("cut").isNull() | (x[VERSION] > F.col("cut"))))["v"].alias(c)
            return gone.select(*self.keys, "r.*", *map(oldest, self.keep))
        newest = rows.groupBy(*self.keys).agg(F.max(VERSION).alias("newest")).alias("n")
        same = reduce(lambda a, b: a & b, (F.col(f"r.{k}").eqNullSafe(F.col(f"n.{k}")) for k in self.keys))
        return rows.alias("r").join(newest, same & (F.col(f"r.{VERSION}") == F.col("n.newest"))).select("r.*")

    def current(self, entries: list[tuple[int, str, int]]) -> DataFrame:
        """Rows of the entries as they are now; buckets with one data folder are read as they lie there."""
        counts: dict[int, int] = {}
        for b, _, _ in entries:
            counts[b] = counts.get(b, 0) + 1
        single = [e for e in entries if counts[e[0]] == 1]
        several = [e for e in entries if counts[e[0]] > 1]
        columns = [*self.schema.names, GONE, VERSION]
        return self.stored(single).select(columns).unionByName(self.settled(self.stored(several)).select(columns))

    def read(self) -> DataFrame:
        return self.current(self.manifest()[1]).filter(~F.col(GONE)).select(self.schema.names)

    def find(self, keys: DataFrame) -> DataFrame:
        """The rows whose keys are among the given ones; only the buckets that those fall in are read."""
        asked = keys.select(*self.keys).distinct()
        touched = {r.b for r in asked.select(self.bucket_of().alias("b")).distinct().collect()}  # a number for each bucket at most
        rows = self.current([e for e in self.manifest()[1] if e[0] in touched]).filter(~F.col(GONE)).select(self.schema.names)
        if self.bloom in self.keys:
            few = [r[0] for r in asked.select(self.bloom).limit(FEW_KEYS + 1).collect()]
            if len(few) <= FEW_KEYS and None not in few:
                rows = rows.filter(F.col(self.bloom).isin(few))  # which the files' Bloom filters answer
        same = reduce(lambda a, b: a & b, (F.col(f"t.{k}").eqNullSafe(F.col(f"k.{k}")) for k in self.keys))
        return rows.alias("t").join(asked.alias("k"), same, "left_semi")

    def compact(self, most: int = 1) -> list[int]:
        """Rewrite the buckets with more than `most` data folders as one each; returns them."""
        newest, entries = self.manifest()
        counts: dict[int, int] = {}
        for b, _, _ in entries:
            counts[b] = counts.get(b, 0) + 1
        full = {b for b, n in counts.items() if n > most}
        if full:
            rows = self.settled(self.stored([e for e in entries if e[0] in full])).filter(~F.col(GONE)).select(*self.schema.names, GONE, VERSION)
            folder, made = self.put(rows.drop(VERSION), F.lit(newest + 1).cast("long"))
            self.commit(newest, [e for e in entries if e[0] not in full] + [(b, folder, newest + 1) for b in made])
        return sorted(full)

    def folders(self) -> dict[int, int]:
        """Data folders of each bucket."""
        out: dict[int, int] = {}
        for b, _, _ in self.manifest()[1]:
            out[b] = out.get(b, 0) + 1
        return out
