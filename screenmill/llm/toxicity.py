"""Toxicity by class-conditional Kneser-Ney models.

For toxic and for ordinary text there is one interpolated Kneser-Ney model of words.  A word's discounted count backs
off to its stem of six characters and this to its stem of four; a stem's count is a continuation count, the number of
different words (or longer stems) of the class that continue it, and its mass is shared evenly by the words known to
continue it and one unknown word, so every level sums to one.  The lowest order is smoothed by counts shared by both
classes.  So a rare or unseen inflection of an expression is judged by what its stem does in each class.  A word's evidence
is the difference of its two log-likelihoods.  A document's features are that difference per word, for the whole document
(length-normalised) and for its most toxic passages of 1, 8 and 64 words, and the excess over one nat, per word and in
all; a logistic curve turns them into the score.

The models count the words of all labelled rows that are not held out.  Neither they nor any list of words pass through
the driver or a broadcast: documents are gathered in blocks of about `block_bytes`; a block keeps each different word once
and its text as a stream of places in that list; the lists meet the counts in shards by stem, and what comes back is a
number for each word of the list.  So a shard gets a word once from each block, however often it occurs.

The logistic curve alone is fitted on a bounded sample of labelled rows (`sample_toxic`, `sample_ordinary`, chosen by a
hash of doc_id), on features from models that leave out a document's own quarter of the rows.  Every document is scored
on its whole text.

Rows: a null text counts as empty and gets the score of no evidence; repeated labels of a doc_id count once, toxic if any
says so; with no labelled row of one of the classes every score is 0; every row yields one row, repeated rows too; other
columns are ignored; an empty table yields an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, block_number, from_planes, gathered, grouped_arrow, hashed, met_arrow, pieces, planes, release, settled, sized, text_bytes

FOLDS = 4
CELLS = 2 * FOLDS
DISCOUNT = 0.75
STEMS = (4, 6)
PASSAGES = (1, 8, 64)
FEATURES = 6
#: What a document without a word has for evidence.
NO_EVIDENCE = -3.0


def held_out(doc_id: Column) -> Column:
    """Labels of these rows are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def known_labels(labels: DataFrame) -> DataFrame:
    """doc_id, toxic and fold of all labelled rows that are not held out."""
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).alias("toxic"))
    known = known.filter(~held_out(F.col("doc_id"))).filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    return known.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(FOLDS)).cast("int"))


def fitting_sample(known: DataFrame, sample_toxic: int, sample_ordinary: int) -> DataFrame:
    """At most about so many labelled rows of each class, by a hash of doc_id."""
    there = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = lambda toxic, most: min(1.0, most / max(1, there.get(toxic, 0)))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) / float(1 << 20)
    return known.filter(draw < F.when(F.col("toxic"), share(True, sample_toxic)).otherwise(share(False, sample_ordinary)))


def packed(*parts: bytes) -> bytes:
    """Byte strings with their sizes, compressed."""
    data = np.array([len(parts), *map(len, parts)], "<i8").tobytes() + b"".join(parts)
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(data, asbytes=True)


def unpacked(data: bytes) -> list[bytes]:
    data = pa.Codec("zstd").decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    ends = np.cumsum(np.r_[8 + 8 * n, np.frombuffer(data, "<i8", n, 8)]).tolist()
    return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


class Vocabulary:
    """Different words, sorted by the hashes of their stems: three arrays of 32 bits, of which the first tells the shard."""

    def __init__(self, four: np.ndarray, six: np.ndarray, word: np.ndarray):
        self.four, self.six, self.word = four, six, word

    def to_bytes(self) -> bytes:
        return packed(*(planes(x) for x in (self.four, self.six, self.word)))

    @classmethod
    def from_bytes(cls, data: bytes) -> Vocabulary:
        parts = unpacked(data)
        return cls(*(from_planes(x, "<u4", len(x) // 4) for x in parts))

    def at(self, rows: np.ndarray | slice) -> Vocabulary:
        return Vocabulary(self.four[rows], self.six[rows], self.word[rows])

    def shards(self, n_shards: int) -> np.ndarray:
        """The places where shards begin, and the end."""
        edges = (np.arange(n_shards, dtype=np.uint64) << np.uint64(32)) // np.uint64(n_shards)
        return np.r_[np.searchsorted(self.four, edges.astype(np.uint32)), len(self.four)]

    def keys(self) -> np.ndarray:
        return (self.six.astype(np.uint64) << np.uint64(32)) | self.word


#: Ranks below this take a byte of a stream.
SHORT = 255


def packed_stream(places: np.ndarray, n_words: int) -> bytes:
    """Places in a list of words as ranks by frequency, with the list's order by rank."""
    order = np.argsort(-np.bincount(places, minlength=n_words), kind="stable")
    rank = np.empty(n_words, np.int64)
    rank[order] = np.arange(n_words)
    ranks = rank[places]
    # words of one frequency stand in the list's order, so steps are small
    return packed(planes(np.diff(order, prepend=0).astype("<i4")), np.minimum(ranks, SHORT).astype(np.uint8).tobytes(), planes((ranks[ranks >= SHORT] - SHORT).astype("<u4")))


def unpacked_stream(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The list's order by rank, and the ranks."""
    steps, head, rest = unpacked(data)
    ranks = np.frombuffer(head, np.uint8).astype(np.int64)
    ranks[ranks == SHORT] += from_planes(rest, "<u4", len(rest) // 4)
    return np.cumsum(from_planes(steps, "<i4", len(steps) // 4), dtype=np.int64), ranks


def word_blocks(texts: DataFrame, block_bytes: int) -> DataFrame:
    """Blocks of the rows (doc_id, text_hash, text, cell): their words, and their texts as places in that list.

    cell: class and fold of a labelled row, else -1.  Columns: block, n_bytes, docs (ids, hashes, cells, sizes), words, stream
    (places), counted (words, cells and numbers of the labelled rows).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for nth, table in enumerate(gathered(batches, block_bytes)):
                yield made(nth, table)
        finally:
            release()

    def made(nth: int, table: pa.Table) -> pa.RecordBatch:
        lists, streams, sizes, n_bytes = [], [], [], 0
        for batch in table.to_batches():
            for part in pieces(batch):
                raw, bounds = text_bytes(part.column(2))
                words = Words(raw, bounds)
                unique, first, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
                lists.append((unique, *(words.hashes(k)[first] for k in STEMS)))
                streams.append(back.astype(np.uint32))
                sizes.append(np.diff(words.rows).astype(np.uint32))
                n_bytes += len(raw)
        unique, four, six = (np.concatenate(x) for x in zip(*lists, strict=True))
        unique, first, back = np.unique(unique, return_index=True, return_inverse=True)
        high = lambda x: (x >> np.uint64(32)).astype(np.uint32)
        four, six, word = high(four[first]), high(six[first]), high(unique)
        order = np.lexsort((word, six, four))
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        place = place[back]
        starts = np.cumsum([0, *(len(x[0]) for x in lists)])
        stream = np.concatenate([place[a : a + len(x[0])][s] for a, x, s in zip(starts.tolist(), lists, streams, strict=False)])
        n_words = np.concatenate(sizes)
        cells = table.column("cell").to_numpy().astype(np.int8)
        known = np.repeat(cells, n_words)
        pairs, numbers = np.unique(stream[known >= 0].astype(np.int64) * CELLS + known[known >= 0], return_counts=True)
        counted = packed(planes((pairs // CELLS).astype("<u4")), (pairs % CELLS).astype(np.uint8).tobytes(), planes(numbers.astype("<u4")))
        ids = table.column("doc_id").combine_chunks()
        there = np.array(ids.is_valid().to_pylist(), np.uint8)
        docs = packed(planes(ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")), there.tobytes(), table.column("text_hash").to_numpy().astype("<i8").tobytes(), cells.tobytes(), planes(n_words.astype("<u4")))
        row = [block_number(nth), n_bytes, docs, Vocabulary(four[order], six[order], word[order]).to_bytes(), packed_stream(stream, len(order)), counted]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, (pa.int64(), pa.int64(), *[pa.binary()] * 4), strict=True)], ["block", "n_bytes", "docs", "words", "stream", "counted"])

    return texts.select("doc_id", "text_hash", "text", "cell").mapInArrow(run, "block long, n_bytes long, docs binary, words binary, stream binary, counted binary")


def count_shards(blocks: DataFrame, n_shards: int) -> DataFrame:
    """shard and the words of a block's labelled rows with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, counted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, cell, number = unpacked(counted)
                at, number = from_planes(at, "<u4", len(cell)), from_planes(number, "<u4", len(cell))
                own = Vocabulary.from_bytes(words).at(at)
                edges = own.shards(n_shards)
                shards = np.flatnonzero(np.diff(edges))
                cut = [(s, slice(int(edges[s]), int(edges[s + 1]))) for s in shards.tolist()]
                rows = [packed(own.at(k).to_bytes(), cell[k], planes(number[k])) for _, k in cut]
                yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(rows, pa.binary())], ["shard", "counts"])
        release()

    return blocks.select("words", "counted").mapInArrow(run, "shard int, counts binary")


def summed(rows: DataFrame) -> DataFrame:
    """shard, counts (of each different word, by class and fold) and totals of each shard."""

    def merge(table: pa.Table) -> pa.Table:
        parts = []
        for data in table.column("counts").to_pylist():
            words, cell, number = unpacked(data)
            own = Vocabulary.from_bytes(words)
            parts.append((own.four, own.six, own.word, np.frombuffer(cell, np.uint8), from_planes(number, "<u4", len(cell))))
        four, six, word, cell, number = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((word, six, four))
        four, six, word = four[order], six[order], word[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (four[1:] != four[:-1]) | (six[1:] != six[:-1]) | (word[1:] != word[:-1])
        of = np.cumsum(fresh) - 1
        counts = np.zeros((CELLS, int(of[-1]) + 1), np.int64)
        np.add.at(counts, (cell[order], of), number[order])
        own = Vocabulary(four[fresh], six[fresh], word[fresh])
        data = packed(own.to_bytes(), *(planes(c.astype("<u4")) for c in counts))
        return pa.table({"shard": table.column("shard").slice(0, 1), "counts": pa.array([data], pa.binary()), "totals": pa.array([ShardModel(own, counts).totals().tolist()], pa.list_(pa.float64()))})

    return grouped_arrow(rows, "shard", merge, "shard int, counts binary, totals array<double>")


def word_counts(rows: DataFrame) -> DataFrame:
    """Occurrences of each different word in the rows (text, toxic, fold) by class and fold (columns n0 to n7)."""
    texts = rows.select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("text_hash"), "text", (F.col("toxic").cast("int") * FOLDS + F.col("fold")).alias("cell"))
    model = summed(count_shards(word_blocks(texts, 1 << 24), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                own, counts = ShardModel.parts(data)
                yield pa.RecordBatch.from_arrays([pa.array(own.keys().view(np.int64)), *map(pa.array, counts)], ["word", *(f"n{c}" for c in range(CELLS))])

    return model.select("counts").mapInArrow(run, "word long, " + ", ".join(f"n{c} long" for c in range(CELLS)))


class ShardModel:
    """The Kneser-Ney models of a shard's words: for each fold left out, and (number FOLDS) for none."""

    def __init__(self, words: Vocabulary, counts: np.ndarray):
        """counts: (class, fold) x words."""
        self.words, self.counts = words, counts
        self.six, at, self.to6 = np.unique((words.four.astype(np.uint64) << np.uint64(32)) | words.six, return_index=True, return_inverse=True)
        self.four, self.to4 = np.unique(words.four[at], return_inverse=True)
        self.types6 = np.bincount(self.to6, minlength=len(self.six))
        self.types4 = np.bincount(self.to4, minlength=len(self.four))

    @staticmethod
    def parts(data: bytes) -> tuple[Vocabulary, np.ndarray]:
        words, *counts = unpacked(data)
        own = Vocabulary.from_bytes(words)
        return own, np.stack([from_planes(c, "<u4", len(own.word)).astype(np.int64) for c in counts])

    def levels(self, model: int, of_class: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the words, and of what continues the stems of six and of four characters."""
        n = self.counts[[of_class * FOLDS + f for f in range(FOLDS) if f != model]].sum(0)
        six = np.bincount(self.to6, n > 0, len(self.six))
        return n, six, np.bincount(self.to4, six > 0, len(self.four))

    def totals(self) -> np.ndarray:
        """Of each model and class the number of words, of different words and of both kinds of stems; last the stems of four."""
        out = [x for m in range(FOLDS + 1) for c in (0, 1) for n, six, four in [self.levels(m, c)] for x in (n.sum(), (n > 0).sum(), (six > 0).sum(), (four > 0).sum())]
        return np.array([*out, len(self.four)], np.float64)

    def evidence(self, totals: np.ndarray, model: int, asked: Vocabulary) -> np.ndarray:
        """Difference of the asked words' log-likelihoods."""
        sums = np.maximum(totals[:-1].reshape(FOLDS + 1, 2, 4)[model], 1)
        per = [self.levels(model, c) for c in (0, 1)]
        shared = (per[0][2] + per[1][2] + 0.5) / (sums[:, 2].sum() + 0.5 * (totals[-1] + 1))
        nothing = 0.5 / (sums[:, 2].sum() + 0.5 * (totals[-1] + 1))
        word, six, four = asked.keys(), (asked.four.astype(np.uint64) << np.uint64(32)) | asked.six, asked.four
        found = []
        for own, keys in ((self.words.keys(), word), (self.six, six), (self.four, four)):
            order = np.argsort(own, kind="stable")
            at = order[np.minimum(np.searchsorted(own, keys, sorter=order), len(own) - 1)]
            found.append((own[at] == keys, at))
        logs = []
        for (n, six_, four_), (words, types, stems6, stems4) in zip(per, sums, strict=True):
            low = np.maximum(four_ - DISCOUNT, 0) / stems6 + DISCOUNT * stems4 / stems6 * shared
            middle = np.maximum(six_ - DISCOUNT, 0) / types + DISCOUNT * stems6 / types * (low / (self.types4 + 1))[self.to4]
            top = np.maximum(n - DISCOUNT, 0) / words + DISCOUNT * types / words * (middle / (self.types6 + 1))[self.to6]
            # the weight of each order is also what is left for words that the order doesn't know
            p = np.where(found[2][0], low[found[2][1]] / (self.types4 + 1)[found[2][1]], DISCOUNT * stems4 / stems6 * nothing) * DISCOUNT * stems6 / types
            p = np.where(found[1][0], middle[found[1][1]] / (self.types6 + 1)[found[1][1]], p) * DISCOUNT * types / words
            logs.append(np.log(np.where(found[0][0], top[found[0][1]], p)))
        return logs[1] - logs[0]


def asked_words(blocks: DataFrame, n_shards: int) -> DataFrame:
    """shard, block and the block's words of that shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = Vocabulary.from_bytes(words)
                edges = own.shards(n_shards)
                shards = np.flatnonzero(np.diff(edges))
                rows = [own.at(slice(int(edges[s]), int(edges[s + 1]))).to_bytes() for s in shards.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array(rows, pa.binary())], ["shard", "block", "words"])
        release()

    return blocks.select("block", "words").mapInArrow(run, "shard int, block long, words binary")


def evidence_of(blocks: DataFrame, model: DataFrame, totals: np.ndarray, n_shards: int, models: tuple[int, ...]) -> DataFrame:
    """block, shard and the evidence of the block's words of that shard, by each of the models."""

    def answer(key: tuple, asked: pa.Table, own: pa.Table) -> pa.Table:
        known = ShardModel(*ShardModel.parts(own.column("counts")[0].as_py())) if own.num_rows else ShardModel(Vocabulary(*[np.zeros(1, np.uint32)] * 3), np.zeros((CELLS, 1), np.int64))
        out = []
        for words in asked.column("words").to_pylist():
            own_words = Vocabulary.from_bytes(words)
            out.append(packed(*(planes(known.evidence(totals, m, own_words).astype("<f2")) for m in models)))
        return pa.table({"block": asked.column("block"), "part": asked.column("shard"), "evidence": pa.array(out, pa.binary())})

    return met_arrow(asked_words(blocks, n_shards), model.select("shard", "counts"), "shard", answer, "block long, part int, evidence binary")


def features(evidence: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Per document: evidence per word, the same of its most toxic passages, and excess over one nat per word and in all."""
    n = np.diff(rows)
    owner = np.repeat(np.arange(len(n)), n)
    size = np.maximum(n, 1)
    excess = np.bincount(owner, np.maximum(evidence - 1.0, 0), len(n))
    upto = np.r_[0.0, np.cumsum(evidence, dtype=np.float64)]
    out = [(upto[rows[1:]] - upto[rows[:-1]]) / size]
    for k in PASSAGES:
        # from each word on, at most to the document's end: a shorter rest counts as if filled with words of no evidence
        ends = np.minimum(np.arange(len(evidence)) + k, rows[owner + 1])
        best = np.full(len(n), NO_EVIDENCE)
        np.maximum.at(best, owner, (upto[ends] - upto[:-1]) / k)
        out.append(best)
    return np.stack([*out, 20 * excess / size, np.log1p(excess)], 1)


def with_features(blocks: DataFrame, evidence: DataFrame, by_fold: bool, curve: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> DataFrame:
    """doc_id, text_hash and the score by the curve, or without one the features and the class; by_fold: by the model that leaves a row's fold out."""

    def work(key: tuple, own: pa.Table, got: pa.Table) -> pa.Table:
        ids, there, hashes, cells, sizes = unpacked(own.column("docs")[0].as_py())
        cells = np.frombuffer(cells, np.int8)
        rows = np.r_[0, np.cumsum(from_planes(sizes, "<u4", len(cells)).astype(np.int64))]
        by_rank, stream = unpacked_stream(own.column("stream")[0].as_py())
        order = np.argsort(got.column("part").to_numpy(), kind="stable").tolist()
        parts = [unpacked(x) for x in got.column("evidence").to_pylist()]
        values = [np.concatenate([from_planes(parts[k][m], "<f2", len(parts[k][m]) // 2) for k in order])[by_rank].astype(np.float32) for m in range(len(parts[0]))] if parts else []
        if not len(stream):
            each = np.zeros(0, np.float32)
        elif by_fold:
            each = np.stack(values)[np.repeat(cells.astype(np.int64) % FOLDS, np.diff(rows)), stream]
        else:
            each = values[0][stream]
        x = features(each, rows)
        doc_id = pa.array(from_planes(ids, "<i8", len(cells)), mask=np.frombuffer(there, np.uint8) == 0)
        if curve is None:
            return pa.table({**{f"x{k}": x[:, k] for k in range(FEATURES)}, "toxic": pa.array(cells >= FOLDS)})
        mean, deviation, weights = curve
        z = np.c_[(x - mean) / deviation, np.ones(len(x))] @ weights
        return pa.table({"doc_id": doc_id, "text_hash": np.frombuffer(hashes, "<i8"), "score": 1 / (1 + np.exp(-np.clip(z, -30, 30)))})

    schema = "doc_id long, text_hash long, score double" if curve is not None else ", ".join(f"x{k} double" for k in range(FEATURES)) + ", toxic boolean"
    return met_arrow(blocks.select("block", "docs", "stream"), evidence, "block", work, schema)


def fitted_curve(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, deviation and weights of a logistic regression by Newton's method with a slight ridge."""
    mean, deviation = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.c_[(x - mean) / deviation, np.ones(len(x))]
    w, ridge = np.zeros(z.shape[1]), 1e-5 * len(y) + 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (p - y) + ridge * w)
    return mean, deviation, w


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample_toxic: int = 4000, sample_ordinary: int = 6000, block_bytes: int = 1 << 24) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    return toxic_rows(docs, labels, threshold, sample_toxic, sample_ordinary, block_bytes).drop("text_hash")


def toxic_rows(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample_toxic: int = 4000, sample_ordinary: int = 6000, block_bytes: int = 1 << 24) -> DataFrame:
    """The same with text_hash, the xxhash64 of the row's text."""
    known = sized(known_labels(labels).select("doc_id", "toxic", "fold", (F.col("toxic").cast("int") * FOLDS + F.col("fold")).alias("cell")))
    texts = hashed(docs)
    blocks = settled(word_blocks(texts.join(known.select("doc_id", "cell"), "doc_id", "left").select("doc_id", "text_hash", "text", F.coalesce("cell", F.lit(-1)).alias("cell")), block_bytes), "toxicity-blocks", blocks=True)
    n_shards = max(8, -(-(blocks.agg(F.sum("n_bytes")).first()[0] or 0) // block_bytes))
    model = settled(summed(count_shards(blocks, n_shards)), "toxicity-counts", blocks=True)
    totals = {r["at"]: r["n"] for r in model.select(F.posexplode("totals").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()}
    totals = np.array([totals.get(k, 0.0) for k in range((FOLDS + 1) * 8 + 1)])
    if totals[:-1].reshape(FOLDS + 1, 2, 4)[FOLDS, :, 0].min() == 0:
        scored = texts.select("doc_id", "text_hash", F.lit(0.0).alias("score"))
    else:
        # the list is bounded by the two parameters, so it is broadcast and the texts are not shuffled
        chosen = fitting_sample(known, sample_toxic, sample_ordinary).select("doc_id", "cell")
        sample = settled(word_blocks(texts.join(F.broadcast(chosen), "doc_id"), block_bytes // 2), "toxicity-sample", blocks=True)
        fit = with_features(sample, evidence_of(sample, model, totals, n_shards, tuple(range(FOLDS))), True, None).toArrow()
        x = np.stack([fit[f"x{k}"].to_numpy() for k in range(FEATURES)], 1)
        y = np.array(fit["toxic"].to_pylist(), np.float64)
        order = np.lexsort(x.T)  # the order in which rows arrive must not matter
        curve = fitted_curve(x[order], y[order])
        scored = with_features(blocks, evidence_of(blocks, model, totals, n_shards, (FOLDS,)), False, curve)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "text_hash")
