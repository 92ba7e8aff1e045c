"""Near-duplicate groups by DartMinHash signatures.

A document's elements are its shingles of five words, weighted by how often they occur; two documents are linked if their
weighted Jaccard similarity (sum of minima over sum of maxima) is at least 0.8.

Signatures: each element owns a strip of the plane of weight and rank, in which a fixed Poisson process of darts is
thrown, cell by cell, by hashing.  A document keeps the darts below its elements' weights and below a rank that lets
about K log K of them through, whatever its size; each dart belongs to one of the K coordinates, and the earliest of a
coordinate is its value.  Coordinates that stay empty are filled by throwing up to twice the rank.  Bands of coordinates
are the keys of a join.

Candidates are verified on the whole texts.  Documents that share a band key with a smaller doc_id are compared with the
smallest of that key, their leader: one comparison for each document and leader.  Two candidates always have a leader in
common, so what is left are documents of one leader in different components.  Those outside the leader's component are
looked up in an inverted index of the leader's documents, in blocks of bounded size, which finds their exact
similarities without a row for each pair; documents that the triangle inequality of the Jaccard distance keeps apart are
left out.  No candidate link between different components is lost.

Words are runs of letters and digits (ASCII case folded); a text of one to four words is one shingle.  Rows: texts
without a word (null, empty) are never near-duplicates and each stays; texts with the same words are one class from the
start; a null doc_id has no class and stays; repeated rows are in one class, and each is kept if its doc_id is the
class's; rows with one doc_id and different words are documents of their own, each with its own links; other columns are
ignored; an empty table yields an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, grouped_arrow, hashed, map_arrow, mix64, pieces, settled, sized, text_bytes

SHINGLE = 5
BANDS, BAND_ROWS = 24, 4
K = BANDS * BAND_ROWS

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
#: Distribution function of the number of darts in a cell of area one.
_POISSON = np.cumsum(np.exp(-1.0) / np.array([1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880, 3628800, 39916800, 479001600], np.float64))
_UNIT = 1.0 / (1 << 53)


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all rows' shingles and the rows' boundaries in them."""
    h, rows = words.hashes(), words.rows
    n = np.diff(rows)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    bounds = np.r_[0, np.cumsum(count)]
    owner = np.repeat(np.arange(len(n)), count)
    first = rows[owner] + np.arange(bounds[-1]) - bounds[owner]
    out = np.zeros(len(first), np.uint64)
    padded = np.r_[h, np.zeros(SHINGLE, np.uint64)]
    for k in range(SHINGLE):
        there = first + k < rows[owner + 1]
        out += np.where(there, padded[first + k], np.uint64(0)) * _ODD[k]
    return mix64(out), bounds


def layers(elements: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """A hash for each unit of an element's weight: the m-th occurrence of an element in its row gets the m-th."""
    order = np.lexsort((elements, owner))
    e, o = elements[order], owner[order]
    fresh = np.r_[True, (e[1:] != e[:-1]) | (o[1:] != o[:-1])] if len(e) else np.zeros(0, bool)
    at = np.arange(len(e))
    nth = at - np.maximum.accumulate(np.where(fresh, at, 0))
    out = np.empty_like(elements)
    out[order] = mix64(e + nth.astype(np.uint64) * _ODD[1])
    return out


def signatures(elements: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """K values for each row; rows without elements get zeros."""
    n = np.diff(bounds)
    out = np.zeros((len(n), K), np.uint64)
    if not len(elements):
        return out
    owner = np.repeat(np.arange(len(n)), n)
    strips = layers(elements, owner)
    thrown = np.zeros(len(n))
    most = (K * np.log(K) + 2 * K) / np.maximum(n, 1)
    todo = n > 0
    while todo.any():
        # only cells that were not thrown before, of rows that have an empty coordinate
        low = np.floor(thrown).astype(np.int64)
        cells = np.where(todo, np.ceil(most).astype(np.int64) - low, 0)
        own = np.flatnonzero(todo[owner])
        per = cells[owner[own]]
        e = np.repeat(own, per)
        cell = np.arange(len(e)) - np.repeat(np.cumsum(per) - per, per) + low[owner[e]]
        seed = mix64(strips[e] + cell.astype(np.uint64) * _ODD[2])
        darts = np.searchsorted(_POISSON, (seed >> np.uint64(11)).astype(np.float64) * _UNIT)
        d = np.repeat(np.arange(len(e)), darts)
        nth = np.arange(len(d)) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = mix64(seed[d] + (nth + 1).astype(np.uint64) * _ODD[3])
        rank = cell[d] + (dart >> np.uint64(11)).astype(np.float64) * _UNIT
        row = owner[e[d]]
        keep = np.flatnonzero((rank < most[row]) & (rank >= thrown[row]))
        keep = keep[np.argsort(-rank[keep], kind="stable")]  # the earliest is written last
        coordinate = (((dart[keep] & np.uint64(2047)) * np.uint64(K)) >> np.uint64(11)).astype(np.int64)
        new = np.zeros_like(out)
        new[row[keep], coordinate] = dart[keep]
        out = np.where(out == 0, new, out)
        thrown = np.where(todo, most, thrown)
        most = 2 * most
        todo = todo & (out == 0).any(1)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    cut = signature.reshape(len(signature), BANDS, BAND_ROWS)
    out = np.zeros((len(signature), BANDS), np.uint64)
    for k in range(BAND_ROWS):
        out = mix64(out + cut[:, :, k] * _ODD[k])
    return mix64(out + np.arange(BANDS, dtype=np.uint64) * _ODD[4])


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, a 128-bit hash of the sequence of words, the band keys (null without words) and the number of shingles of every document."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = Words(*text_bytes(batch.column(2)))
            h, rows = words.hashes(), words.rows
            n = np.diff(rows)
            owner = np.repeat(np.arange(len(n)), n)
            place = (np.arange(len(h)) - rows[owner]).astype(np.uint64)
            same = []
            for k in (0, 1):
                total = np.r_[np.uint64(0), np.cumsum(mix64(h + mix64((place + np.uint64(1)) * _ODD[k]) * _ODD[k + 2]))]
                same.append(mix64(total[rows[1:]] - total[rows[:-1]]).view(np.int64))
            elements, bounds = shingles(words)
            keys = band_keys(signatures(elements, bounds)).view(np.int64)
            offsets = pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS)
            bands = pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()), mask=pa.array(n == 0))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same[0]), pa.array(same[1]), bands, pa.array(np.diff(bounds))], ["doc_id", "text_hash", "h1", "h2", "bands", "size"])

        return work

    return map_arrow(hashed(docs).filter("doc_id IS NOT NULL"), make, "doc_id long, text_hash long, h1 long, h2 long, bands array<long>, size long")


#: Members that meet one copy of their leader's text, and the shingles that a task gets at once.
MEMBERS, TASK_SHINGLES = 64, 1_500_000


def layered(table: pa.Table) -> list[np.ndarray]:
    """Hashes of the unit layers of each row's shingles; one piece of text at a time, so that they are the largest thing in memory."""
    sets = []
    for batch in table.select(["text"]).combine_chunks().to_batches():
        for part in pieces(batch):
            elements, bounds = shingles(Words(*text_bytes(part.column(0))))
            units = layers(elements, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)))
            sets += [units[x:y].copy() for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return sets


def similarities(pairs: DataFrame, texts: DataFrame, n_tasks: int) -> DataFrame:
    """a, b, shared and total (sums of minima and of maxima) and size (of b) of each pair of a leader a and a member b.

    A leader's members are dealt to groups of about MEMBERS, and its text is sent once to each group.
    """
    groups = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("n"))
    members = pairs.join(groups, "a").select("a", F.pmod(F.xxhash64("b"), F.col("n")).cast("int").alias("part"), F.col("b").alias("node"))
    leaders = groups.select("a", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"), F.col("a").alias("node"))
    rows = members.unionByName(leaders).join(texts, "node").withColumn("deal", F.pmod(F.xxhash64("a", "part"), F.lit(n_tasks)))

    def compare(table: pa.Table) -> pa.Table:
        a, part, node = (table.column(c).to_numpy() for c in ("a", "part", "node"))
        sets = layered(table)
        order = np.lexsort((node != a, part, a))
        edges = np.flatnonzero(np.r_[True, (np.diff(a[order]) != 0) | (np.diff(part[order]) != 0), True])
        out: list[tuple[int, int, int, int, int]] = []
        for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            leader, *others = order[x:y].tolist()  # the leader's row comes first
            if not others or node[leader] != a[leader]:
                continue
            own = np.sort(sets[leader])
            sizes = [len(sets[k]) for k in others]
            every = np.concatenate([sets[k] for k in others])
            hit = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
            shared = np.bincount(np.repeat(np.arange(len(others)), sizes), hit, len(others)).astype(np.int64)
            out += [(int(a[k]), int(node[k]), n, len(own) + size - n, size) for k, n, size in zip(others, shared.tolist(), sizes, strict=True)]
        columns = zip(*out, strict=True) if out else [[]] * 5
        return pa.table({k: pa.array(list(v), pa.int64()) for k, v in zip(("a", "b", "shared", "total", "size"), columns, strict=True)})

    return grouped_arrow(rows.select("a", "part", "node", "text", "deal"), "deal", compare, "a long, b long, shared long, total long, size long")


#: Rows of ids that a task of the last stage of a written table is given.
IDS_A_TASK = 100_000


def tasks_for(rows: int, each: int) -> int:
    return max(8, -(-rows // each))


def components(links: DataFrame, most: int) -> DataFrame:
    """node and root, the smallest node of its component, of all nodes of the links (a, b), of which there are most at most.

    In each round labels fall to the smallest of the neighbours' and then to their own label's label, until none changes;
    each round's labels are written, which cuts their lineage.
    """
    tasks = tasks_for(most, IDS_A_TASK)
    edges = settled(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges", tasks)
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root"))
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        fallen = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        above = labels.select(F.col("node").alias("low"), F.col("root").alias("above"))
        new = settled(fallen.join(above, "low", "left").select("node", F.col("root").alias("old"), F.least("low", "above").alias("root")), "labels", tasks)
        labels = new.select("node", "root")
        if new.filter("root <> old").isEmpty():
            return labels


#: Documents, and shingles, of a leader that meet in one block as queries or in the index.
BLOCK, BLOCK_SHINGLES = 1000, 750_000


def linked_in_blocks(rows: DataFrame, n_groups: int, threshold_percent: int) -> DataFrame:
    """Links (a, b) between components, named by their roots: rows have leader, q and i (block numbers), role, doc_id, root and text.

    In each block the queries (role q) are looked up in the index of the others (role i).  Of a block's links those that join
    roots which its links so far don't join are returned: fewer than it has roots, with the same components.
    """
    dealt = rows.withColumn("deal", F.pmod(F.xxhash64("leader", "q", "i"), F.lit(n_groups)))

    def find(table: pa.Table) -> pa.Table:
        leader, q, i = (table.column(c).to_numpy() for c in ("leader", "q", "i"))
        ids, roots = table.column("doc_id").to_numpy(), table.column("root").to_numpy()
        query = np.array(table.column("role").to_pylist()) == "q"
        sets = layered(table)
        order = np.lexsort((ids, i, q, leader))
        starts = np.flatnonzero(np.r_[True, (np.diff(leader[order]) != 0) | (np.diff(q[order]) != 0) | (np.diff(i[order]) != 0), True])
        a, b = [], []
        for x, y in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            block = order[x:y]
            index, asks = block[~query[block]], block[query[block]]
            if not len(index) or not len(asks):
                continue
            sizes = np.array([len(sets[k]) for k in index])
            keys = np.concatenate([sets[k] for k in index])
            by = np.argsort(keys, kind="stable")
            keys, owner = keys[by], np.repeat(np.arange(len(index)), sizes)[by]
            names, place = np.unique(roots[block], return_inverse=True)
            own, asked = place[~query[block]], place[query[block]]
            joined = np.arange(len(names))  # by root: the first root that it is joined with so far
            for k, mine in zip(asks.tolist(), asked.tolist(), strict=True):
                low, high = np.searchsorted(keys, sets[k], "left"), np.searchsorted(keys, sets[k], "right")
                n = high - low
                at = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
                shared = np.bincount(owner[at], minlength=len(index))
                close = (shared * 100 >= (sizes + len(sets[k]) - shared) * threshold_percent) & (joined[own] != joined[mine])
                if close.any():
                    first, *others = np.unique(np.r_[joined[own[close]], joined[mine]])
                    a += [int(names[first])] * len(others)
                    b += names[others].tolist()
                    joined[np.isin(joined, others)] = first
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return grouped_arrow(dealt, "deal", find, "a long, b long")


def near_groups(docs: DataFrame, threshold_percent: int = 80) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its near-duplicate group) and kept, of every row."""
    return near_rows(docs, threshold_percent).select("doc_id", "class_id", "kept")


def near_rows(docs: DataFrame, threshold_percent: int = 80) -> DataFrame:
    """The same with text_hash, the xxhash64 of the row's text."""
    signs = settled(signed(docs), "signatures")
    classes = settled(word_classes(signs), "classes")
    banded = classes.select("node", F.explode("bands").alias("key"))
    leaders = banded.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    pairs = settled(banded.join(leaders, "key").filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "pairs", tasks_for(signs.count(), IDS_A_TASK))
    n_pairs = pairs.count()
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = sized(asked.join(classes.select("node", F.col("first").alias("doc_id"), "text_hash", "size"), "node"))
    n_wanted, shingles_wanted = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    texts = settled(hashed(docs).join(wanted.drop("size"), ["doc_id", "text_hash"]).select("node", "text"), "candidate-texts", tasks_for(shingles_wanted, TASK_SHINGLES))
    if texts.count() > n_wanted:  # rows that repeat doc_id and text
        texts = settled(texts.dropDuplicates(["node"]), "candidate-texts")

    compared = settled(similarities(pairs, texts, tasks_for(2 * shingles_wanted, TASK_SHINGLES)), "similarities", tasks_for(n_pairs, IDS_A_TASK))
    roots = components(compared.filter(F.col("shared") * 100 >= F.col("total") * threshold_percent), n_pairs)

    # what is left: documents of one leader in different components that may be close by their distances to it
    reach = (100 - threshold_percent) / 100 + 1e-9
    own = roots.withColumnRenamed("node", "doc_id")
    members = compared.select(F.col("a").alias("leader"), F.col("b").alias("doc_id"), (1 - F.col("shared") / F.col("total")).alias("d"), "size").join(own, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    members = members.join(own.select(F.col("doc_id").alias("leader"), F.col("root").alias("leader_root")), "leader", "left").withColumn("outside", F.col("root") != F.coalesce("leader_root", "leader"))
    members = settled(members.select("leader", "doc_id", "d", "size", "root", "outside"), "members", tasks_for(n_pairs, IDS_A_TASK))
    counts = members.groupBy("leader").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count_if("outside").alias("n_out"), F.coalesce(F.sum(F.when(F.col("outside"), F.col("size"))), F.lit(0)).alias("size_out"), F.min(F.when(F.col("outside"), F.col("d"))).alias("nearest"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")
    )
    blocks = lambda n, size: F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(size) / BLOCK_SHINGLES)).cast("int")
    counts = counts.filter("low <> high AND n_out > 0").select("leader", "nearest", "n_out", "n", "size_out", "size", blocks("n_out", "size_out").alias("n_q"), blocks("n", "size").alias("n_i"))
    total, shingles_met = counts.agg(F.sum(F.col("n_out") * F.col("n_i") + F.col("n") * F.col("n_q")), F.sum(F.col("size_out") * F.col("n_i") + F.col("size") * F.col("n_q"))).first()
    if total:
        # a document within reach of the leader can only be close to one outside that is within twice the reach
        left = members.join(counts.drop("size"), "leader").filter(F.col("outside") | (F.col("nearest") <= F.col("d") + reach))
        deal = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        asks = left.filter("outside").select("leader", "doc_id", "root", F.lit("q").alias("role"), deal(F.col("n_q")).alias("q"), every(F.col("n_i")).alias("i"))
        index = left.select("leader", "doc_id", "root", F.lit("i").alias("role"), every(F.col("n_q")).alias("q"), deal(F.col("n_i")).alias("i"))
        met = asks.unionByName(index).join(texts.withColumnRenamed("node", "doc_id"), "doc_id")
        joints = settled(linked_in_blocks(met, max(-(-total // (2 * BLOCK)), -(-shingles_met // TASK_SHINGLES)), threshold_percent).distinct(), "joints", tasks_for(total, IDS_A_TASK))
        upper = components(joints, joints.count()).select(F.col("node").alias("root"), F.col("root").alias("top"))
        roots = roots.select("node", "root").unionByName(joints.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))).distinct()
        roots = roots.join(upper, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    found = classes.select("h1", "h2", "first", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = found.join(found.groupBy("root").agg(F.min("first").alias("class_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "root", "left").select("h1", "h2", F.coalesce("class_id", "first").alias("class_id"))
    hash_of = lambda c: F.when(F.col("bands").isNotNull(), F.col(c)).alias(c)
    rows = signs.select("doc_id", "text_hash", hash_of("h1"), hash_of("h2")).join(named, ["h1", "h2"], "left").select("doc_id", "text_hash", F.coalesce("class_id", "doc_id").alias("class_id"))
    nameless = hashed(docs).filter("doc_id IS NULL").select("doc_id", "text_hash", F.lit(None).cast("long").alias("class_id"))
    return rows.unionByName(nameless).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def word_classes(signs: DataFrame) -> DataFrame:
    """One row for each different sequence of words: its hash, its first row (doc_id `first`, text_hash) and a node.

    The node is the first doc_id, or a negative number made of the hash where one doc_id has several sequences of words.
    """
    same = signs.filter("bands IS NOT NULL").groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "text_hash", "bands", "size")).alias("m")).select("h1", "h2", F.col("m.doc_id").alias("first"), "m.text_hash", "m.bands", "m.size")
    clash = sized(signs.filter("bands IS NOT NULL").groupBy(F.col("doc_id").alias("first")).agg((F.min(F.struct("h1", "h2")) != F.max(F.struct("h1", "h2"))).alias("clash")).filter("clash"))
    other = F.xxhash64("h1", "h2", "first").bitwiseOR(F.lit(-(1 << 63)))
    return same.join(clash, "first", "left").select("h1", "h2", "first", "text_hash", "bands", "size", F.when(F.col("clash"), other).otherwise(F.col("first")).alias("node"))
