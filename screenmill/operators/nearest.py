"""A stored index for exact top-k search by cosine similarity: clusters with bounds, of which a query meets only some.

Vectors are scaled to length one, so the nearest by cosine are the nearest by distance.  Centroids come from a bounded
sample; every vector goes to its nearest one.  Sorted by cluster and distance from the centroid, the vectors are cut into
parts of bounded bytes, so a part is a shell round a centroid: its rows lie between two distances.  By the triangle
inequality a query whose distance from the centroid is d is at least d - outer and at least inner - d away from all rows
of a shell, and at most d + outer.

A search has two rounds.  First each query meets the shells that are certain to hold k rows nearest to it by those upper
bounds; the k-th distance found is its reach.  Then it meets the other shells whose lower bound is within its reach.
No shell is left out that could hold one of the k nearest, so results equal a search through all pairs.

Only the list of shells (five numbers each) and the centroids are held by the tasks that choose shells; both are bounded.
Queries that meet a shell are dealt to blocks, so neither a shell that all queries meet nor a query is one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from screenmill.sources.io import written

#: Bytes of vectors (as doubles) of a shell, and of the sample of rows that the centroids come from.
SHELL_BYTES, SAMPLE_BYTES = 8 << 20, 32 << 20
#: Most centroids and shells: what the choosing tasks hold (32 MB of centroids of 1000 numbers, 8 MB of shells).
MOST_CENTROIDS, MOST_SHELLS = 4096, 200_000
#: Queries that meet a shell in one group, rows of the tiles of both whose similarities are held at once (8 MB), and queries whose bounds are.
BLOCK_ROWS, TILE, CHOOSE_ROWS = 8192, 1024, 64
#: Distances are compared with this much room for rounding.
ROOM = 1e-5
#: Similarities are rounded to so many digits, so that equal vectors tie wherever they stand in a product.
DIGITS = 12


def unit_rows(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the places of the vectors that have one and aren't zero, and the vectors scaled to length one."""
    sizes, out = pc.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False), {}
    for d in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == d)
        own = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
        norm = np.linalg.norm(own, axis=1)
        use = np.flatnonzero(np.isfinite(norm) & (norm > 0))
        if len(use):
            out[d] = at[use], own[use] / norm[use, None]
    return out


def top_rows(ids: np.ndarray, a: np.ndarray, names: np.ndarray, b: np.ndarray, k: int, tile: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each query of a its k most similar rows of b, as (ids, names, similarities); ties by names, which ascend."""
    for low in range(0, len(ids), tile):
        best: tuple[np.ndarray, np.ndarray] | None = None
        for at in range(0, len(names), tile):
            sim = np.round(a[low : low + tile] @ b[at : at + tile].T, DIGITS)
            place = np.broadcast_to(np.arange(at, at + sim.shape[1]), sim.shape)
            if best is not None:  # what was found before has smaller names, so it wins ties
                sim, place = np.concatenate([best[0], sim], 1), np.concatenate([best[1], place], 1)
            if sim.shape[1] > k:
                # all that are as similar as the k-th, then the first k by similarity and name
                bound = np.partition(sim, sim.shape[1] - k, axis=1)[:, sim.shape[1] - k][:, None]
                order = np.argsort(np.where(sim >= bound, -sim, np.inf), axis=1, kind="stable")[:, :k]
                sim, place = np.take_along_axis(sim, order, 1), np.take_along_axis(place, order, 1)
            best = sim, place
        if best is not None:
            yield np.repeat(ids[low : low + tile], best[0].shape[1]), names[best[1]].ravel(), best[0].ravel()


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between the unit vectors of both."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def centroids_of(sample: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """n unit vectors at most, each the middle of the rows of the sample that are nearest to it."""
    rng = np.random.default_rng(5)
    made = sample[rng.choice(len(sample), min(n, len(sample)), replace=False)]
    for _ in range(rounds):
        of = np.concatenate([np.argmax(sample[at : at + TILE] @ made.T, 1) for at in range(0, len(sample), TILE)])
        total = np.zeros_like(made)
        np.add.at(total, of, sample)
        norm = np.linalg.norm(total, axis=1)
        made = np.where(norm[:, None] > 0, total / np.where(norm > 0, norm, 1)[:, None], made)
    return made


def spaced(df: DataFrame, key: str, scope: str | None) -> DataFrame:
    """space (the scope and the length of the vector, which alone can meet), id and embedding."""
    within = F.col(scope).cast("string") if scope else F.lit("")
    rows = df.filter("size(embedding) > 0").filter(within.isNotNull())
    return rows.select(F.concat(F.size("embedding").cast("string"), F.lit(":"), within).alias("space"), F.col(key).alias("id"), "embedding")


class Shells:
    """The list of shells by space: number, cluster (-1: no centroid), inner and outer distance, rows; and the centroids by length."""

    def __init__(self, shells: list[tuple], centroids: dict[int, np.ndarray]):
        self.centroids, by = centroids, {}
        for space, *numbers in shells:
            by.setdefault(space, []).append(numbers)
        self.spaces = {}
        for space, rows in by.items():
            number, cluster, inner, outer, n = (np.array(x) for x in zip(*rows, strict=True))
            self.spaces[space] = number.astype(np.int64), cluster.astype(np.int64), inner.astype(float), outer.astype(float), n.astype(np.int64)

    def bounds(self, space: str, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest distance from each vector to the rows of each shell of the space."""
        _, cluster, inner, outer, _ = self.spaces[space]
        known = self.centroids.get(vectors.shape[1])
        if known is None:
            return np.zeros((len(vectors), len(cluster))), np.full((len(vectors), len(cluster)), 2.0)
        used, at = np.unique(cluster, return_inverse=True)
        away = distances(vectors, known[np.maximum(used, 0)])[:, at]
        least = np.maximum(np.maximum(away - outer, inner - away), 0.0)
        free = cluster < 0
        least[:, free], away[:, free] = 0.0, 2.0
        return least, np.where(free, 2.0, away + outer)

    def home(self, space: str, vectors: np.ndarray, k: int) -> np.ndarray:
        """The shells that hold k rows within the smallest upper bounds, as a mask."""
        _, upper = self.bounds(space, vectors)
        order = np.argsort(upper, axis=1, kind="stable")
        n = self.spaces[space][4][order]
        first = np.cumsum(n, axis=1) - n < k  # those before which fewer than k rows stand
        out = np.zeros_like(first)
        np.put_along_axis(out, order, first, 1)
        return out


class Index:
    """Written below path: vectors (space, shell, id, embedding), shells and centroids."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path
        self.vectors = spark.read.parquet(f"{path}/vectors")
        rows = spark.read.parquet(f"{path}/shells").select("space", "shell", "cluster", "inner", "outer", "n").collect()  # MOST_SHELLS at most
        known: dict[int, list] = {}
        for r in spark.read.parquet(f"{path}/centroids").orderBy("size", "cluster").collect():  # MOST_CENTROIDS at most
            known.setdefault(r.size, []).append(r.embedding)
        self.shells = Shells([tuple(r) for r in rows], {d: np.array(x) for d, x in known.items()})
        self.rows = sum(r.n for r in rows)

    def chosen(self, queries: DataFrame, k: int, reach: bool) -> DataFrame:
        """queries with each shell that they meet: their home shells, or with reach all others within it."""
        shells = self.shells
        fields = {f.name: f.dataType for f in queries.schema if f.name != "reach"}
        kinds = [to_arrow_type(t) for t in fields.values()]

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                spaces = np.array(batch.column("space").to_pylist(), dtype=object)
                far = batch.column("reach").to_numpy(zero_copy_only=False) if reach else None
                for _, (at, unit) in unit_rows(batch.column("embedding")).items():
                    for space in set(spaces[at].tolist()) & shells.spaces.keys():
                        own = np.flatnonzero(spaces[at] == space)
                        for low in range(0, len(own), CHOOSE_ROWS):
                            some = own[low : low + CHOOSE_ROWS]
                            meets = shells.home(space, unit[some], k)
                            if reach:
                                least, _ = shells.bounds(space, unit[some])
                                meets = ~meets & (least <= far[at[some]][:, None] + ROOM)
                            q, s = np.nonzero(meets)
                            for start in range(0, len(q), 4 * BLOCK_ROWS):
                                cut = slice(start, start + 4 * BLOCK_ROWS)
                                taken = batch.take(pa.array(at[some][q[cut]]))
                                columns = [taken.column(c).cast(t) for c, t in zip(fields, kinds, strict=True)]
                                yield pa.RecordBatch.from_arrays([*columns, pa.array(shells.spaces[space][0][s[cut]], pa.int64())], [*fields, "shell"])

        return queries.mapInArrow(choose, ", ".join(f"{n} {t.simpleString()}" for n, t in fields.items()) + ", shell long")

    def met(self, chosen: DataFrame, k: int) -> DataFrame:
        """query_id, space, chunk_id and similarity: of each query and shell the k most similar rows."""
        types = chosen.schema["id"].dataType, self.vectors.schema["id"].dataType
        # the queries of a shell are dealt to blocks, and its rows are copied once for each
        blocks = chosen.groupBy("space", "shell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
        left = chosen.join(blocks, ["space", "shell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
        right = self.vectors.join(blocks, ["space", "shell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        return left.groupBy("space", "shell", "block").cogroup(right.groupBy("space", "shell", "block")).applyInArrow(meeting(types, k), f"query_id {types[0].simpleString()}, space string, chunk_id {types[1].simpleString()}, similarity double")

    def search(self, queries: DataFrame, k: int, scope: str | None = None) -> DataFrame:
        """query_id, rank, chunk_id and similarity of each query's k nearest rows; ties by chunk_id."""
        asked = spaced(queries, "query_id", scope)
        near = self.met(self.chosen(asked, k, False), k).transform(written, "nearest-home")
        # the k-th similarity so far; a query whose spaces hold fewer than k rows has met them all at home
        last = top(near, k).groupBy("query_id", "space").agg(F.min("similarity").alias("kth"))
        reach = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("kth")))
        joined = asked.join(last.select(F.col("query_id").alias("id"), "space", reach.alias("reach")), ["id", "space"])
        rest = self.met(self.chosen(joined.select("space", "id", "embedding", "reach"), k, True), k)
        return top(near.unionByName(rest), k).select("query_id", "rank", "chunk_id", "similarity")

    def effort(self, queries: DataFrame, k: int, scope: str | None = None) -> DataFrame:
        """One row: pairs, all pairs of a query and a row of its space, and compared, those that the search compares."""
        asked = spaced(queries, "query_id", scope)
        shells = asked.sparkSession.read.parquet(f"{self.path}/shells").select("space", "shell", "n")
        first = self.chosen(asked, k, False)
        last = top(self.met(first, k), k).groupBy("query_id", "space").agg(F.min("similarity").alias("kth"))
        joined = asked.join(last.select(F.col("query_id").alias("id"), "space", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("kth"))).alias("reach")), ["id", "space"])
        both = first.select("space", "shell").unionByName(self.chosen(joined.select("space", "id", "embedding", "reach"), k, True).select("space", "shell"))
        compared = both.join(shells, ["space", "shell"]).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("compared"))
        sizes = shells.groupBy("space").agg(F.sum("n").alias("n"))
        return asked.groupBy("space").agg(F.count(F.lit(1)).alias("q")).join(sizes, "space").agg(F.coalesce(F.sum(F.col("q") * F.col("n")), F.lit(0)).alias("pairs")).join(compared)


def meeting(types: tuple[DataType, DataType], k: int, tile: int = TILE):
    """The work of one group: the queries of a block and the rows of a shell."""
    target = pa.schema([("query_id", to_arrow_type(types[0])), ("space", pa.string()), ("chunk_id", to_arrow_type(types[1])), ("similarity", pa.float64())])

    def meet(key: tuple, q: pa.Table, c: pa.Table) -> pa.Table:
        found = []
        sides = [(x.column("id").combine_chunks(), unit_rows(x.column("embedding").combine_chunks())) if x.num_rows else (None, {}) for x in (q, c)]
        (ids, asked), (names, own) = sides
        for d in asked.keys() & own.keys():
            (at, a), (to, b) = asked[d], own[d]
            these = names.take(pa.array(to)).to_numpy(zero_copy_only=False)
            order = np.argsort(these, kind="stable")
            found += top_rows(ids.take(pa.array(at)).to_numpy(zero_copy_only=False), a, these[order], b[order], k, tile)
        parts = [np.concatenate(x).tolist() for x in zip(*found, strict=True)] if found else [[], [], []]
        space = q.column("space")[0].as_py() if q.num_rows and "space" in q.column_names else ""
        return pa.table({"query_id": pa.array(parts[0], target.field(0).type), "space": pa.array([space] * len(parts[0]), pa.string()), "chunk_id": pa.array(parts[1], target.field(2).type), "similarity": pa.array(parts[2], pa.float64())})

    return meet


def top(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def build_index(chunks: DataFrame, path: str, scope: str | None = None, shell_rows: int | None = None) -> Index:
    """Write an index of chunks (chunk_id, embedding, and the scope) below path.

    Zero vectors, null and empty ones match nothing and are left out.  shell_rows: rows of a shell, by SHELL_BYTES if not given.
    """
    spark = chunks.sparkSession
    rows = spaced(chunks, "chunk_id", scope)
    counts = rows.groupBy("space").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("size"))
    total, size = rows.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    shell_rows = shell_rows or max(256, min(1 << 14, SHELL_BYTES // (8 * (size or 1))))
    shell_rows = max(shell_rows, -(-total // MOST_SHELLS))
    # a bounded sample of whole rows, whatever the table's size
    most = max(1, SAMPLE_BYTES // (8 * (size or 1)))
    sample = rows.select("embedding").sample(min(1.0, 1.2 * most / max(total, 1)), 5).limit(most).toArrow().column(0).combine_chunks()
    n = max(1, min(MOST_CENTROIDS, total // shell_rows, len(sample) // 8 or 1))
    known = {d: centroids_of(unit, n) for d, (_, unit) in unit_rows(sample).items()} if len(sample) else {}
    # a space that fits in one shell needs no clusters
    small = {r.space for r in counts.filter(F.col("n") <= shell_rows).select("space").limit(MOST_SHELLS).collect()}
    vector = rows.schema["embedding"].dataType.simpleString()
    id_type, arrow_id = rows.schema["id"].dataType.simpleString(), to_arrow_type(rows.schema["id"].dataType)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, (at, unit) in unit_rows(batch.column("embedding")).items():
                space = batch.column("space").take(pa.array(at))
                cluster, away = np.full(len(at), -1), np.zeros(len(at))
                if d in known:
                    use = np.flatnonzero([s not in small for s in space.to_pylist()])
                    for low in range(0, len(use), TILE):
                        some = use[low : low + TILE]
                        far = distances(unit[some], known[d])
                        cluster[some] = far.argmin(1)
                        away[some] = far.min(1)
                yield pa.RecordBatch.from_arrays([space, pa.array(cluster, pa.int32()), pa.array(away), batch.column("id").take(pa.array(at)).cast(arrow_id), batch.column("embedding").take(pa.array(at))], ["space", "cluster", "away", "id", "embedding"])

    assigned = written(rows.mapInArrow(assign, f"space string, cluster int, away double, id {id_type}, embedding {vector}"), "nearest-assigned")
    by = ["space", "cluster", "away", F.xxhash64("id")]  # equal vectors, however many, are dealt too
    ranged = assigned.repartitionByRange(max(1, -(-total // shell_rows)), *by)
    # a part of one partition and cluster is a shell; its number is unique in its space
    shell = F.spark_partition_id().cast("long") * (MOST_CENTROIDS + 1) + F.col("cluster") + 1
    ranged.withColumn("shell", shell).write.mode("overwrite").parquet(f"{path}/vectors")
    stored = spark.read.parquet(f"{path}/vectors")
    stored.groupBy("space", "shell", "cluster").agg(F.min("away").alias("inner"), F.max("away").alias("outer"), F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/shells")
    spark.createDataFrame([(d, k, x.tolist()) for d, c in known.items() for k, x in enumerate(c)], "size int, cluster int, embedding array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    return Index(spark, path)
