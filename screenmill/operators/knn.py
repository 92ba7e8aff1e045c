"""Exact filtered top-k search by cosine similarity, for whole batches of queries."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenmill.operators.nearest import build_index, meeting, top
from screenmill.sources.io import work_folder

#: Rows of queries and of chunks that meet in a group; and of the tiles of both whose similarities are held at once (8 MB).
QUERY_ROWS, CHUNK_ROWS, TILE = 8192, 16384, 1024
#: Chunks beyond which a search builds an index.
INDEX_ROWS = 8 * CHUNK_ROWS


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null for a zero vector or different lengths."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def knn(queries: DataFrame, chunks: DataFrame, k: int, scope: str | None = None, index_rows: int = INDEX_ROWS) -> DataFrame:
    """query_id, rank, chunk_id and similarity of each query's k nearest chunks; ties by chunk_id.

    Beyond index_rows chunks an index of clusters is written in the shared folder, of which each query meets only what its
    bounds leave (operators/nearest.py); fewer are compared in pairs.  The rows are the same.
    """
    if chunks.count() <= index_rows:
        return knn_pairs(queries, chunks, k, scope)
    return build_index(chunks, work_folder(chunks.sparkSession, "nearest"), scope).search(queries, k, scope)


def knn_pairs(queries: DataFrame, chunks: DataFrame, k: int, scope: str | None = None, query_rows: int = QUERY_ROWS, chunk_rows: int = CHUNK_ROWS, tile: int = TILE) -> DataFrame:
    """The same by comparing all pairs.

    Both sides are dealt to parts of about query_rows and chunk_rows by a hash, and every part of the queries meets every
    part of the chunks in a group of its own: nothing passes through the driver, chunks are copied once for each
    query_rows queries, and a task holds the vectors of two parts and the similarities of two tiles.  A group keeps k rows a
    query, so only these are shuffled.  With a scope (a column of both) only parts of one scope meet.  Zero vectors and
    vectors of another length match nothing.
    """
    within = F.col(scope) if scope else F.lit(0)
    asked = queries.filter("size(embedding) > 0").select(within.alias("scope"), F.col("query_id").alias("id"), "embedding").filter("scope IS NOT NULL")
    known = chunks.filter("size(embedding) > 0").select(within.alias("scope"), F.col("chunk_id").alias("id"), "embedding").filter("scope IS NOT NULL")
    # the parts of each scope: the chunks' rows are copied once for each part of the scope's queries
    n_asked, n_known = (df.groupBy("scope").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name)) for df, name, rows in ((asked, "n_q", query_rows), (known, "n_c", chunk_rows)))
    parts = n_asked.join(n_known, "scope")
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(parts, "scope").select("scope", part("n_q").alias("q"), every("n_c").alias("c"), "id", F.col("embedding").alias("embedding"))
    right = known.join(parts, "scope").select("scope", every("n_q").alias("q"), part("n_c").alias("c"), "id", F.col("embedding").alias("embedding"))

    types = asked.schema["id"].dataType, known.schema["id"].dataType
    meet = meeting(types, k, tile)
    hits = left.groupBy("scope", "q", "c").cogroup(right.groupBy("scope", "q", "c")).applyInArrow(meet, f"query_id {types[0].simpleString()}, space string, chunk_id {types[1].simpleString()}, similarity double")
    return top(hits, k).select("query_id", "rank", "chunk_id", "similarity")


def hit_stats(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id").agg(F.min("similarity").alias("min_similarity"), F.max("similarity").alias("max_similarity"), F.avg("similarity").alias("mean_similarity"), F.count(F.lit(1)).alias("n_hits"))


def embedder(fn: Callable[[list[str]], list[list[float]]] | None = None, dim: int = 64):
    """A pandas UDF from text to array<float>; without fn a deterministic feature-hash embedding of words."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        if fn is not None:
            return pd.Series(fn(texts.fillna("").tolist()))
        import zlib

        out = []
        for text in texts.fillna(""):
            v = np.zeros(dim, np.float32)
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                v[h % dim] += 1.0 if h >> 31 else -1.0
            n = np.linalg.norm(v)
            out.append(v / n if n else v)
        return pd.Series(out)

    return embed
