"""A Merkle manifest of a table: a leaf for each row, a tree for each language, one root, and a proof for every row.

Of a row's fields H (sha256, as lower-case hexadecimal digits) makes a leaf.  In a group leaves ascend by id; while a
level has several nodes, every run of WIDTH neighbours (the last may be shorter, even one node) becomes the H of their
digests.  What remains of a group is its subroot; the subroots, by group, make the root in the same way.

Places are global: rows are range-partitioned and sorted by group and id, numbered in their partition, and what a group
has in earlier partitions is added, so no group is ever one task.  A tier of LEVELS levels is worked on in chunks of
WIDTH^LEVELS neighbours: one window, whose rows look at their siblings by lag and lead with fixed offsets, 1 to
WIDTH - 1 times the stride of the level, masked by the slot in the run and by the number of nodes that the level has; the
first child of a run hashes its parent.  Chunks begin where runs begin, so no run is cut, and the levels of a tier need
one shuffle.  The first rows of all chunks are the next tier's nodes.  On the way down each tier's rows take the path of
their chunk from the tier above, which is WIDTH^LEVELS times smaller: a path lists what stands left and right on each
level, from the leaf to the root.  The windows of a tier are computed once for its tops and once for its paths, which are
ten times as long as the rows and are never written.

Rows: a null field is `-`; null ids come first, rows with one id ascend by their leaves, and rows alike in all fields
are leaves of their own; a null group is a group, the first; a lone leaf is its subroot, a lone subroot the root, and the
proof of a table with one row is the H of nothing; other columns are ignored; an empty table yields an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

#: Children of a node, and levels that one window makes: its chunks have WIDTH^LEVELS rows.
WIDTH, LEVELS = 8, 3
#: A tier's paths (a few KB a row) are broadcast to the tier below up to so many rows, else shuffled by chunk.
BROADCAST_NODES = 5_000
#: The same for the list of runs of sorted rows, a hundred bytes each.
BROADCAST_RUNS = 100_000

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(x: Column) -> Column:
    return F.sha2(x, 256)


def field(value: Column) -> Column:
    """`-` for null, else the number of bytes in UTF-8, a colon and the value."""
    value = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_of(values: dict[str, Column]) -> Column:
    return digest(F.concat(*(field(v) for v in values.values())))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows (part, ...) with pos, the place from 0 in their part by the given columns, and size, the rows of the part."""
    apart = rows.withColumn("at", F.rand(7))  # rows alike in all fields are dealt too
    ranged = apart.repartitionByRange("part", *order, "at").sortWithinPartitions("part", *order)
    numbered = settled(ranged.withColumn("at", F.monotonically_increasing_id()), "manifest-sorted")
    # rows of this table: one for each partition and part that it has
    runs = numbered.groupBy("part", F.shiftright("at", 33).alias("task")).agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("n"))
    of_part = Window.partitionBy("part")
    before = F.coalesce(F.sum("n").over(of_part.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = settled(runs.select("part", "task", (before - F.col("low")).alias("shift"), F.sum("n").over(of_part).alias("size")), "manifest-runs", 64)
    runs = F.broadcast(runs) if runs.count() <= BROADCAST_RUNS else runs
    here, there = numbered.withColumn("task", F.shiftright("at", 33)).alias("here"), runs.alias("there")
    same = (F.col("here.task") == F.col("there.task")) & (F.col("here.part") == F.col("there.part"))
    others = [F.col(f"here.{c}") for c in rows.columns]
    return here.join(there, same).select(*others, (F.col("at") + F.col("shift")).alias("pos"), "size")


def tier(nodes: DataFrame) -> DataFrame:
    """Nodes (part, pos, size, hash, ...) with chunk, steps (left and right on the tier's levels) and, in a chunk's first row, top."""
    rows = nodes.withColumn("chunk", F.floor(F.col("pos") / WIDTH**LEVELS))
    chunk = Window.partitionBy("part", "chunk").orderBy("pos")
    for level in range(LEVELS):
        stride = WIDTH**level
        at, count, node = F.floor(F.col("pos") / stride), F.ceil(F.col("size") / stride), "hash" if level == 0 else f"node{level}"
        slot = at % WIDTH
        # nodes of this level stand in every stride-th row; a level with one node isn't hashed
        live = (F.col("pos") % stride == 0) & (count > 1)
        left = [F.when(slot >= k, F.lag(node, k * stride).over(chunk)) for k in range(WIDTH - 1, 0, -1)]
        right = [F.when((slot + k < WIDTH) & (at + k < count), F.lead(node, k * stride).over(chunk)) for k in range(1, WIDTH)]
        rows = rows.withColumns({f"left{level}": F.when(live, F.concat_ws("", *left)), f"right{level}": F.when(live, F.concat_ws("", *right))})
        parent = F.when(live, digest(F.concat(f"left{level}", node, f"right{level}"))).otherwise(F.col(node))
        rows = rows.withColumn(f"node{level + 1}", F.when(F.col("pos") % (stride * WIDTH) == 0, parent))
    # what stands beside a parent is in the row of its first child, the last such row up to here
    held = chunk.rowsBetween(Window.unboundedPreceding, 0)
    beside = [F.struct(*(F.last(f"{s}{level}", ignorenulls=True).over(held).alias(s) for s in ("left", "right"))) for level in range(LEVELS)]
    return rows.select(*nodes.columns, "chunk", F.array(*beside).alias("steps"), F.col(f"node{LEVELS}").alias("top"))


def climb(nodes: DataFrame) -> list[DataFrame]:
    """The nodes and those of the tiers above, each WIDTH^LEVELS times smaller; the last has one node for each part."""
    tiers, most = [nodes], nodes.agg(F.max("size")).first()[0] or 0
    while most > 1:
        tops = tier(tiers[-1]).filter("top IS NOT NULL")
        size = F.ceil(F.col("size") / WIDTH**LEVELS)
        tiers.append(settled(tops.select("part", F.col("chunk").alias("pos"), size.alias("size"), F.col("top").alias("hash")), "manifest-nodes"))
        most = -(-most // WIDTH**LEVELS)
    return tiers


def descend(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """The rows of the lowest tier with path, and what above (part, path, ...), a row for each part, says of their part."""
    carried = [c for c in above.columns if c not in ("part", "path")]
    above = above.withColumn("pos", F.lit(0).cast("long"))
    if len(tiers) == 1:
        return tiers[0].join(above, ["part", "pos"])
    for nodes in reversed(tiers[:-1]):
        above = above.select("part", F.col("pos").alias("chunk"), F.col("path").alias("further"), *carried)
        if nodes is not tiers[-2]:
            above = settled(above, "manifest-paths")
        if above.count() <= BROADCAST_NODES:
            above = F.broadcast(above)
        own = F.filter("steps", lambda s: s["left"].isNotNull())
        above = tier(nodes).join(above, ["part", "chunk"]).select(*nodes.columns, F.concat(own, "further").alias("path"), *carried)
    return above


def folded(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""
    return F.aggregate(path, start, lambda node, s: digest(F.concat(s["left"], node, s["right"])))


def tree(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Leaves (group, hash, the columns of order, ...) with subroot, root and path.

    A group is text or null; in a group the leaves ascend by the columns of order.
    """
    others = [c for c in leaves.columns if c not in ("group", "hash")]
    # "" is the null group, which comes first; text follows bytewise
    part = F.coalesce(F.concat(F.lit("="), F.col("group").cast("string")), F.lit(""))
    tiers = climb(placed(leaves.select(part.alias("part"), "hash", *others), order))
    subroots = tiers[-1].select("part", F.col("hash").alias("subroot"))
    second = climb(placed(subroots.select(F.lit("").alias("part"), F.col("part").alias("of"), F.col("subroot").alias("hash"), "subroot"), ["of"]))
    none = F.array().cast("array<struct<left:string,right:string>>")
    roots = descend(second, second[-1].select("part", none.alias("path"), F.col("hash").alias("root")))
    above = settled(roots.select(F.col("of").alias("part"), "path", "subroot", "root"), "manifest-roots")
    return descend(tiers, above)


def leaves_of(docs: DataFrame) -> DataFrame:
    """group, doc_id, leaf of every row as hash, and altered, the leaf after tampering where it is due, else null."""
    values = {c: F.col(c) for c in FIELDS}
    lower = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    due = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    altered = F.when(due, leaf_of(values | {"text": lower}))
    return docs.select(F.col("lang").cast("string").alias("group"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(values).alias("hash"), altered.alias("altered"))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row."""
    rows = tree(settled(leaves_of(docs), "manifest-leaves"), ["doc_id", "hash"])
    again = folded(F.coalesce("altered", "hash"), F.col("path"))
    rows = rows.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", digest(F.concat_ws("", F.transform("path", lambda s: F.concat(s["left"], s["right"])))).alias("proof_sha256"), again.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


MANIFEST_SQL = r"""
WITH RECURSIVE
k AS (SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384::BIGINT, a >> 1) ELSE a >> 1 END)) AS tab),
e AS (SELECT row_number() OVER () AS r, doc_id, lang, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(tab[(xor(a, b) & 255) + 1], a >> 8)), 4294967295::BIGINT) AS crc
  FROM documents, k),
d AS (SELECT r, doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, CASE WHEN crc % 3 = 0 THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS altered FROM e),
p AS (SELECT *, coalesce('=' || lang, '') AS part, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
up AS (SELECT 0 AS lvl, part, pos, n, leaf AS h FROM p
  UNION ALL SELECT lvl + 1, part, pos // 8, max((n + 7) // 8), sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY lvl, part, pos // 8),
s AS (SELECT part, h AS subroot, row_number() OVER (ORDER BY part) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
up2 AS (SELECT 0 AS lvl, pos, n, subroot AS h FROM s
  UNION ALL SELECT lvl + 1, pos // 8, max((n + 7) // 8), sha256(string_agg(h, '' ORDER BY pos)) FROM up2 WHERE n > 1 GROUP BY lvl, pos // 8),
runs AS (SELECT lvl, part, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM up WHERE n > 1 GROUP BY ALL),
runs2 AS (SELECT lvl, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM up2 WHERE n > 1 GROUP BY ALL),
f AS (SELECT 0 AS lvl, r, part, pos, n, coalesce(altered, leaf) AS node, '' AS beside FROM p
  UNION ALL SELECT lvl + 1, r, part, pos // 8, (n + 7) // 8, sha256(array_to_string(hs[:pos % 8], '') || node || array_to_string(hs[pos % 8 + 2:], '')), beside || array_to_string(hs[:pos % 8], '') || array_to_string(hs[pos % 8 + 2:], '')
  FROM f JOIN runs USING (lvl, part) WHERE run = pos // 8 AND n > 1),
f2 AS (SELECT 0 AS lvl, r, part, s.pos, s.n, node, beside FROM f JOIN s USING (part) WHERE f.n = 1
  UNION ALL SELECT lvl + 1, r, part, pos // 8, (n + 7) // 8, sha256(array_to_string(hs[:pos % 8], '') || node || array_to_string(hs[pos % 8 + 2:], '')), beside || array_to_string(hs[:pos % 8], '') || array_to_string(hs[pos % 8 + 2:], '')
  FROM f2 JOIN runs2 USING (lvl) WHERE run = pos // 8 AND n > 1)
SELECT doc_id, leaf, subroot, h AS root, sha256(beside) AS proof_sha256, node AS folded_root, node = h AS verified
FROM f2 JOIN d USING (r) JOIN s USING (part), (SELECT h FROM up2 WHERE n = 1) WHERE f2.n = 1
"""
