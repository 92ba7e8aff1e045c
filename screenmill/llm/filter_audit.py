"""How filters interact: what every order of a list of filters removes, where, and what is lost.

A document's failure mask has a bit for each filter that it fails.  In an order of the filters it is removed at the first
filter of its mask, so all that an order does follows from the counts of the masks, at most 2^n for each part.  Orders
are ranked lexicographically (the rank is the number of their Lehmer code): those that begin alike are an interval of
ranks, and the step that removes a mask is the same over each of a few such intervals.  Each mask's counts are added at
the beginnings of its intervals and taken off at their ends, in an array of differences for each step; a running sum over
the ranks gives what every order removes at every step.  No document meets any order.

Documents are read once, into narrow rows.  Of equal texts the smallest doc_id is found by combining in each task first,
and only the list of texts that have copies meets the rows again.

Rows: a null text counts as empty; a null source counts as the empty string; a null doc_id has no labels, is no copy of
anything and nothing is a copy of it; rows with the same doc_id and text are not copies of each other, as neither id is
smaller, and count as often as they come; a doc_id with several rows of labels has a label if any of them has it; labels
without a document count nowhere; other columns are ignored; an empty table yields an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, grouped_left, settled, whole_text
from .quality import let, words_of


@dataclass(frozen=True)
class Filter:
    """A document fails if the test of its text and words holds; without a test, if a smaller doc_id has the same text."""

    name: str
    fails: Callable[[Column, Column], Column] | None


def letter_share(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100


FILTERS = (
    Filter("A", lambda text, words: F.size(words) < 200),
    Filter("B", lambda text, words: F.size(F.array_distinct(words)) * 100 < F.size(words) * 50),
    Filter("C", lambda text, words: letter_share(text) > F.char_length(text) * 2),
    Filter("D", lambda text, words: text.rlike("[#$%&*|]")),
    Filter("E", None),
)


def removal_intervals(n: int, mask: int) -> Iterator[tuple[int, int, int]]:
    """(step, low, high): in the orders ranked low to high - 1 the mask is removed at the step; neighbours are made one."""

    def walk(step: int, low: int, left: tuple[int, ...]) -> Iterator[tuple[int, int, int]]:
        size = factorial(len(left) - 1)
        for k, f in enumerate(left):
            if mask >> f & 1:
                yield step, low + k * size, low + (k + 1) * size
            else:
                yield from walk(step + 1, low + k * size, left[:k] + left[k + 1 :])

    held: dict[int, tuple[int, int]] = {}
    for step, low, high in walk(1, 0, tuple(range(n))) if mask else ():
        before = held.get(step)
        if before and before[1] == low:
            held[step] = (before[0], high)
        else:
            if before:
                yield step, *before
            held[step] = (low, high)
    for step, (low, high) in held.items():
        yield step, low, high


def failure_masks(docs: DataFrame, filters: tuple[Filter, ...] = FILTERS, part: str = "source") -> DataFrame:
    """doc_id, part and mask of every row."""
    text, words = F.col("text"), F.col("words")

    def bits(words: Column) -> Column:
        out = F.lit(0)
        for k, f in enumerate(filters):
            if f.fails:
                out = out + F.when(f.fails(text, words), F.lit(1 << k)).otherwise(F.lit(0))
        return out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), whole_text().alias("text"))
    rows = rows.select("doc_id", "part", let(words_of(text), bits).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    copies = sum(1 << k for k, f in enumerate(filters) if not f.fails)
    if not copies:
        return rows.drop("digest")
    rows = settled(rows, "audit-rows")
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("size"))
    groups = settled(groups.filter("first < last").select("digest", "first", "size"), "audit-copies")
    met = grouped_left(rows, groups, "digest", rows.count())
    return met.select("doc_id", "part", F.when(F.col("doc_id") > F.col("first"), F.col("mask") + copies).otherwise(F.col("mask")).alias("mask"))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """n, good and toxic by part and mask."""
    flag = lambda name: F.max((F.coalesce(F.col(name).cast("int"), F.lit(0)) == 1).cast("int")).alias(name)
    marked = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality"), flag("toxic"))
    marked = settled(marked.filter("quality = 1 OR toxic = 1"), "audit-labels", 64)
    rows = masks.withColumn("n", F.lit(1))
    if marked.count() <= BROADCAST_ROWS:
        marked = F.broadcast(marked)
    else:  # rows that repeat are combined before they are shuffled to the labels, so that no doc_id is hot
        rows = masks.groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(marked, "doc_id", "left")
    total = lambda name: F.sum(F.when(F.col(name) == 1, F.col("n")).otherwise(F.lit(0)))
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), total("quality").alias("good"), total("toxic").alias("toxic"))


def orders_report(counts: DataFrame, names: str) -> DataFrame:
    """The report of every part, order and step from the counts (part, mask, n, good, toxic); names: a letter for each bit."""
    spark, n = counts.sparkSession, len(names)
    if n > 6:
        raise ValueError("at most six filters: the report has n! orders")
    # two tables of fixed size: the ends of all intervals, and the orders
    ends: dict[tuple[int, int, int], int] = {}
    for mask in range(1, 1 << n):
        for step, low, high in removal_intervals(n, mask):
            for rank, sign in ((low, 1), (high, -1)):
                ends[mask, step, rank] = ends.get((mask, step, rank), 0) + sign
    signs = spark.createDataFrame([(*k, v) for k, v in ends.items() if v], "mask int, step int, rank int, sign int")
    orders = [(rank, "".join(names[k] for k in order), s + 1, k) for rank, order in enumerate(permutations(range(n))) for s, k in enumerate(order)]
    orders = spark.createDataFrame(orders, "rank int, filter_order string, step int, bit int")

    # a part's 2^n rows at most become the arrays of differences
    counts = settled(counts, "audit-counts", 64)
    change = lambda name: F.sum(F.col("sign") * F.col(name)).alias(name)
    differences = counts.join(F.broadcast(signs), "mask").groupBy("part", "step", "rank").agg(change("n"), change("good"), change("toxic"))
    per_bit = lambda test: F.array(*(F.sum(F.when(test(1 << k), F.col("n")).otherwise(F.lit(0))) for k in range(n)))
    totals = counts.groupBy("part").agg(
        F.sum("n").alias("total"),
        per_bit(lambda bit: F.col("mask").bitwiseAND(bit) != 0).alias("failing"),
        per_bit(lambda bit: F.col("mask") == bit).alias("only"),
    )
    places = totals.select("*", F.explode(F.sequence(F.lit(0), F.lit(factorial(n) - 1))).alias("rank"))
    places = places.join(F.broadcast(orders), "rank").join(differences, ["part", "step", "rank"], "left")
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    summed = lambda name: F.coalesce(F.sum(name).over(along), F.lit(0)).cast("long")
    swept = places.select("part", "filter_order", "rank", "step", "bit", "total", "failing", "only", summed("n").alias("removed"), summed("good").alias("good_lost"), summed("toxic").alias("toxic_lost"))
    so_far = F.sum("removed").over(Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    return swept.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - so_far).cast("long").alias("kept"),
        "removed",
        (F.get("failing", F.col("bit")) - F.col("removed")).cast("long").alias("redundant"),
        F.get("only", F.col("bit")).cast("long").alias("unique_fails"),
        "good_lost",
        "toxic_lost",
        F.sum("removed").over(Window.partitionBy("part", "bit")).cast("long").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, filters: tuple[Filter, ...] = FILTERS, part: str = "source") -> DataFrame:
    """One row for each part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return orders_report(mask_counts(failure_masks(docs, filters, part), labels), "".join(f.name for f in filters))


AUDIT_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT t.doc_id, part, t.text, regexp_extract_all(t.text, '[^\x20\x09-\x0D]+') AS words, first
  FROM t JOIN (SELECT text, min(doc_id) AS first FROM t GROUP BY text) f ON t.text = f.text),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, concat(CASE WHEN len(words) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' END,
    CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) THEN 'C' END, CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END,
    CASE WHEN w.doc_id > first THEN 'E' END) AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM w LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
s AS (SELECT part, filter_order, step, filter_order[step] AS letter, n, good, toxic, contains(fails, filter_order[step]) AS failing, fails,
    coalesce(list_min(list_transform(list_filter(string_split(fails, ''), lambda x: x <> ''), lambda x: strpos(filter_order, x))), 9) AS gone_at
  FROM m, o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step::INT AS step, letter, coalesce(sum(n) FILTER (gone_at > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (gone_at = step), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (failing AND gone_at < step), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = letter), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (gone_at = step), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (gone_at = step), 0)::BIGINT AS toxic_lost
  FROM s GROUP BY 1, 2, 3, 4)
SELECT * EXCLUDE (letter), (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r
"""
