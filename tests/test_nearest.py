"""The index of shells against a search through all pairs, and the share of pairs that its bounds skip."""

from __future__ import annotations

import numpy as np
import pytest

from screenmill.operators import knn as K
from screenmill.operators import nearest as N


def clustered(n, d, middles, seed, spread=0.15):
    """Rows round some middles, a third of them round the first, with repeated, zero, null and shorter vectors."""
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(1).normal(size=(middles, d))
    of = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, middles, n))
    x = centres[of] + spread * rng.normal(size=(n, d))
    x[: n // 10] = x[0]
    rows = [(k, v.tolist(), int(c) % 3) for k, (v, c) in enumerate(zip(x, of, strict=True))]
    rows[-1] = (n - 1, [0.0] * d, 0)
    rows[-2] = (n - 2, None, 0)
    rows[-3] = (n - 3, [1.0, 2.0], None)
    rows[-4] = (n - 4, [], 1)
    rows[-5] = (n - 5, [1.0, 0.5], 1)
    return rows


def frames(spark):
    chunks = spark.createDataFrame(clustered(3000, 12, 20, 2), "chunk_id long, embedding array<float>, team int")
    queries = spark.createDataFrame(clustered(60, 12, 20, 3), "query_id long, embedding array<float>, team int")
    return queries, chunks


def ranked(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.similarity, 9)) for r in df.collect())


@pytest.mark.parametrize("scope", [None, "team"])
def test_equals_all_pairs(spark, tmp_path, monkeypatch, scope):
    monkeypatch.setattr(N, "BLOCK_ROWS", 16)
    queries, chunks = frames(spark)
    index = N.build_index(chunks, f"{tmp_path}/index", scope, shell_rows=50)
    want = ranked(K.knn_pairs(queries, chunks, 7, scope))
    assert ranked(index.search(queries, 7, scope)) == want
    assert ranked(N.Index(spark, f"{tmp_path}/index").search(queries, 7, scope)) == want
    done = index.effort(queries, 7, scope).first()
    # 0.29 and 0.36 when written
    assert 0 < done.compared < (0.45 if scope else 0.35) * done.pairs
    # more than a scope has
    few = queries.filter("query_id < 5")
    assert ranked(index.search(few, 4000, scope)) == ranked(K.knn_pairs(few, chunks, 4000, scope))
    assert all(r.n <= 60 for r in spark.read.parquet(f"{tmp_path}/index/shells").collect())


def test_without_structure(spark, tmp_path):
    """Bounds that skip nothing still give right results; texts are ids too."""
    rng = np.random.default_rng(4)
    rows = [(f"c{k:04}", v.tolist()) for k, v in enumerate(rng.normal(size=(900, 40)))]
    chunks = spark.createDataFrame(rows, "chunk_id string, embedding array<double>")
    queries = spark.createDataFrame(rows[::45], "query_id string, embedding array<double>")
    index = N.build_index(chunks, f"{tmp_path}/index", shell_rows=100)
    assert ranked(index.search(queries, 5)) == ranked(K.knn_pairs(queries, chunks, 5))
    assert ranked(K.knn(queries, chunks, 5, index_rows=10)) == ranked(K.knn_pairs(queries, chunks, 5))


def test_empty(spark, tmp_path):
    queries, chunks = frames(spark)
    index = N.build_index(chunks.limit(0), f"{tmp_path}/index")
    assert index.search(queries, 3).count() == 0
    full = N.build_index(chunks, f"{tmp_path}/full", shell_rows=500)
    assert full.search(queries.limit(0), 3).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    middles = N.centroids_of(x, 9)
    far = N.distances(x, middles)
    of, away = far.argmin(1), far.min(1)
    shell = (of * 3 + np.minimum((away * 3).astype(int), 2)).astype(int)
    rows = [("s", int(s), int(of[shell == s][0]), float(away[shell == s].min()), float(away[shell == s].max()), int((shell == s).sum())) for s in np.unique(shell)]
    shells = N.Shells(rows, {6: middles})
    q = x[:50]
    least, most = shells.bounds("s", q)
    true = N.distances(q, x)
    for k, s in enumerate(np.unique(shell)):
        assert (least[:, k] <= true[:, shell == s].min(1) + N.ROOM).all() and (most[:, k] >= true[:, shell == s].max(1) - N.ROOM).all()
    home = shells.home("s", q, 20)
    assert (home @ shells.spaces["s"][4] >= 20).all()
