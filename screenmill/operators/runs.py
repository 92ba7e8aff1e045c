"""Greedy grouping of sorted rows: a row joins the group before it or begins one, as the sizes so far allow.

Whether a row joins depends on the whole row of decisions before it, but only through one number, the size of the open
group, which is bounded: nothing joins a group over the largest size.  So what a run of rows does is a table, from the
size at its beginning to the size at its end, and such tables compose.  Each task makes the table of its own rows, in
which nearly all sizes soon lead to the same end; tables are put together in order, a few numbers for each task; then each
task decides its rows with the size that it now knows.  A document or a run of any length is worked on by as many tasks
as it fills.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screenmill.sources.io import written

#: Rows of a task.
TASK_ROWS = 1 << 17


def in_order(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows in tasks of about TASK_ROWS, sorted over all tasks, with task and at, a number that ascends with the order."""
    n = max(1, -(-rows.count() // TASK_ROWS))
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return written(ranged.withColumn("at", F.monotonically_increasing_id()), "sorted").withColumn("task", F.shiftright("at", 33).cast("int"))


class Rule:
    """A row of n joins if it may, the group is open, and the sum is at most `most` and one of both is below `least`.

    Sizes are states: 0 is closed, s stands for an open group of s - 1.
    """

    def __init__(self, least: int, most: int):
        self.least, self.most = least, most

    def table(self, n: np.ndarray, may: np.ndarray, opens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By the state before the rows: the state after them, and the at of the last group that begins in them (-1: none does)."""
        state, begin = np.arange(self.most + 2), np.full(self.most + 2, -1, np.int64)
        of = np.arange(self.most + 2)  # from a state at the beginning to its place among those that are still different
        for k in range(len(n)):
            joins = (state > 0) & may[k] & (state - 1 + n[k] <= self.most) & ((state - 1 < self.least) | (n[k] < self.least))
            state = np.where(joins, state + n[k], n[k] + 1 if opens[k] else 0)
            begin = np.where(joins, begin, at[k])
            if len(state) > 1 and (not may[k] or k % 16 == 15):
                (state, begin), inverse = np.unique(np.stack([state, begin]), axis=1, return_inverse=True)
                of = inverse.ravel()[of]
            if len(state) == 1:
                after, last, _ = self.decided(n[k + 1 :], may[k + 1 :], opens[k + 1 :], at[k + 1 :], int(state[0]), int(begin[0]))
                return np.full(len(of), after), np.full(len(of), last)
        return state[of], begin[of]

    def decided(self, n: np.ndarray, may: np.ndarray, opens: np.ndarray, at: np.ndarray, state: int, begin: int) -> tuple[int, int, np.ndarray]:
        """The state after the rows, the begin of the last group, and the begin of each row's group."""
        out = []
        for size, can, grows, here in zip(n.tolist(), may.tolist(), opens.tolist(), at.tolist(), strict=True):
            if state and can and state - 1 + size <= self.most and (state - 1 < self.least or size < self.least):
                state += size
            else:
                state, begin = size + 1 if grows else 0, here
            out.append(begin)
        return state, begin, np.array(out, np.int64)


def sorted_columns(rows: pa.Table) -> tuple[list, list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rows = rows.sort_by("at")
    numbers = [rows.column(c).to_numpy() for c in ("n", "may", "opens", "at")]
    return rows.column("doc_id").to_pylist(), rows.column("key").to_pylist(), *numbers


def grouped(rows: DataFrame, rule: Rule) -> DataFrame:
    """at and begin, the at of the first row of its group, of sorted rows (task, at, doc_id, key, n, may, opens).

    Rows join only rows of their document and key; a null key joins nothing.
    """

    def alike(docs: list, keys: list) -> np.ndarray:
        return np.array([k > 0 and keys[k] is not None and keys[k] == keys[k - 1] and docs[k] == docs[k - 1] for k in range(len(keys))], bool)

    def ends(rows: pa.Table) -> pa.Table:
        docs, keys, n, may, opens, at = sorted_columns(rows)
        same = alike(docs, keys)
        same[0] = keys[0] is not None  # if it isn't, the state before it will be 0
        state, begin = rule.table(n, may & same, opens, at)
        edge = np.flatnonzero(np.r_[True, (np.diff(state) != 0) | (np.diff(begin) != 0)])
        # along a stretch of states that all rows have joined the state after them ascends by one, too
        shift = state - np.arange(len(state))
        steady = np.flatnonzero(np.r_[True, (np.diff(shift) != 0) | (np.diff(begin) != 0)])
        use, rising = (steady, True) if len(steady) < len(edge) else (edge, False)
        return pa.table(
            {"task": [rows.column("task")[0].as_py()], "first_doc": [docs[0]], "first_key": [keys[0]], "last_doc": [docs[-1]], "last_key": [keys[-1]], "rising": [rising], "from": pa.array([use.tolist()], pa.list_(pa.int32())), "to": pa.array([state[use].tolist()], pa.list_(pa.int32())), "begin": pa.array([begin[use].tolist()], pa.list_(pa.int64()))},
            schema=ends_schema,
        )

    doc = pa.from_numpy_dtype(np.int64) if dict(rows.dtypes)["doc_id"] == "bigint" else pa.string()
    kind = "long" if doc == pa.int64() else "string"
    ends_schema = pa.schema([("task", pa.int32()), ("first_doc", doc), ("first_key", pa.string()), ("last_doc", doc), ("last_key", pa.string()), ("rising", pa.bool_()), ("from", pa.list_(pa.int32())), ("to", pa.list_(pa.int32())), ("begin", pa.list_(pa.int64()))])
    narrow = rows.select("task", "at", "doc_id", "key", "n", "may", "opens")
    tables = narrow.groupBy("task").applyInArrow(ends, f"task int, first_doc {kind}, first_key string, last_doc {kind}, last_key string, rising boolean, from array<int>, to array<int>, begin array<long>")
    # a row for each task, a few numbers long; put together in order
    entry: dict[int, tuple[int, int]] = {}
    state, begin, before = 0, -1, None
    for t in sorted(tables.collect(), key=lambda t: t.task):
        if before is None or t.first_key is None or (t.first_doc, t.first_key) != before:
            state, begin = 0, -1
        entry[t.task] = state, begin
        k = int(np.searchsorted(t["from"], state, "right")) - 1
        state, last = t.to[k] + (state - t["from"][k] if t.rising else 0), t.begin[k]
        begin, before = last if last >= 0 else begin, (t.last_doc, t.last_key)

    def decide(rows: pa.Table) -> pa.Table:
        docs, keys, n, may, opens, at = sorted_columns(rows)
        same = alike(docs, keys)
        state, begin = entry[rows.column("task")[0].as_py()]
        same[0] = state > 0
        return pa.table({"at": at, "begin": rule.decided(n, may & same, opens, at, state, begin)[2]})

    return narrow.groupBy("task").applyInArrow(decide, "at long, begin long")


def numbered(firsts: DataFrame) -> DataFrame:
    """Rows (doc_id, at) with number, their place from 0 in their document; counted by task, then over tasks."""
    task = F.shiftright("at", 33)
    here = firsts.withColumn("task", task)
    counts = here.groupBy("doc_id", "task").agg(F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("doc_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("doc_id").alias("_doc"), F.col("task").alias("_task"), before.alias("_before"))
    local = here.withColumn("_nth", F.row_number().over(Window.partitionBy("doc_id", "task").orderBy("at")))
    met = local.join(counts, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("task") == F.col("_task")))
    return met.withColumn("number", (F.col("_before") + F.col("_nth") - 1).cast("int")).drop("_doc", "_task", "_before", "_nth", "task")
