"""Greedy groups over many tasks against the same passes over lists; scans and spans against loops."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_chunking import LEAST, MOST, plain_merge

from screenmill.functions import text as X
from screenmill.operators import chunking as C
from screenmill.operators import runs


def pieces(seed, docs, length, sizes):
    """(doc_id, pos, index, n, key, solo) of documents; few keys change, so runs go on over tasks."""
    rng = random.Random(seed)
    rows = []
    for doc in docs:
        key = "a"
        for pos in range(length):
            key = rng.choice([key] * 40 + ["b", None, "a"])
            if rng.random() < 0.02:
                rows += [(doc, pos, k, rng.choice([5, 70, 160]), key, False) for k in range(3)]
            else:
                rows.append((doc, pos, 0, rng.choice(sizes), key, True))
    return rows


def plain_marks(rows):
    out = {}
    for doc in {r[0] for r in rows}:
        own = sorted(((r[1], r[2], r[3], r[4], r[5]) for r in rows if r[0] == doc), key=lambda r: r[:2])
        groups = plain_merge([(n, key, solo) for _, _, n, key, solo in own])
        for no, group in enumerate(groups):
            for k in group:
                out[doc, own[k][0], own[k][1]] = no, len(group)
    return out


@pytest.mark.parametrize(("seed", "docs", "length", "sizes"), [(1, ["d"], 1500, (1, 3, 8, 30, 120)), (2, ["x", "y", None], 200, (0, 1, 25, 149, 151)), (3, ["z"], 600, (0, 0, 0, 1)), (4, [str(k) for k in range(90)], 4, (10, 60))])
def test_marks_over_many_tasks(spark, monkeypatch, seed, docs, length, sizes):
    monkeypatch.setattr(runs, "TASK_ROWS", 40)
    rows = pieces(seed, docs, length, sizes)
    frame = spark.createDataFrame(rows, "doc_id string, pos int, index int, n int, key string, solo boolean").withColumn("item", F.monotonically_increasing_id())
    marks = C.chunk_marks(frame, LEAST, MOST).join(frame, "item").collect()
    assert {(r.doc_id, r.pos, r["index"]): (r.chunk_no, r.pieces) for r in marks} == plain_marks(rows)
    assert len(marks) == len(rows)


def test_tables_compose():
    """The table of rows equals deciding them from every size."""
    rng = np.random.default_rng(2)
    rule = runs.Rule(LEAST, MOST)
    for size in (0, 1, 9, 70):
        n, may, opens = rng.integers(0, 90, size), rng.random(size) < 0.95, rng.random(size) < 0.7
        at = np.arange(size) * 3
        state, begin = rule.table(n, may, opens, at)
        for s in range(MOST + 2):
            after, last, _ = rule.decided(n, may, opens, at, s, -1)
            assert (state[s], begin[s]) == (after, last)


def test_nothing_to_chunk(spark):
    empty = spark.createDataFrame([], "doc_id string, pos int, index int, n int, key string, solo boolean").withColumn("item", F.monotonically_increasing_id())
    assert C.chunk_marks(empty, LEAST, MOST).count() == 0


def test_scans(spark):
    rng = random.Random(5)
    for size in (0, 1, 255, 256, 257, 1500):
        weights = [rng.choice([1, 30, 80, 200]) for _ in range(size)]
        row = spark.createDataFrame([(weights,)], "w array<int>").select(C.bins(F.col("w"), 150, 90).alias("of"), C.scan(F.col("w"), F.lit(0), lambda s, x: s + x, lambda s: s, "int").alias("sums")).first()
        of, bin_, filled = [], -1, 0
        for w in weights:
            if bin_ < 0 or w > 150 or filled > 150 or filled + w > 90:
                bin_, filled = bin_ + 1, 0
            filled += w
            of.append(bin_)
        assert list(row["of"]) == of and list(row.sums) == np.cumsum(weights).tolist()


def test_spans_and_binned(spark):
    row = spark.createDataFrame([(list("abcdef"), [0, 0, 1, 2, 2, 2])], "x array<string>, of array<int>").select(X.span(F.col("x"), F.lit(1), F.lit(3)).alias("s"), X.span(F.col("x"), F.lit(2), F.lit(2)).alias("none"), C.binned(F.col("x"), F.col("of")).alias("b")).first()
    assert (row.s, row.none, row.b) == (["b", "c"], [], [["a", "b"], ["c"], ["d", "e", "f"]])
