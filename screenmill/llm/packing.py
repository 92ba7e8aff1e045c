"""Lexical retrieval packing of documents into token sequences.

A first pass encodes each document once, and a Spark aggregation counts the BM25 statistics (document frequencies, number
and mean length of documents) over all of them.  Documents are then sorted by lexical content: the key is a list of four
min-hashes over a document's terms, in which a term counts by its square idf and terms of a single document come last.
The order is cut into shards of at most `shard_docs` documents and `shard_bytes` of ids.  So documents with a common rare
term lie side by side, a term of more documents than a shard holds is split by the next min-hash, and whole rows are kept.
Each shard has a BM25 inverted index of its documents' token ids: lists of postings, whose sums are a seed's scores.  A sequence starts with a seed (the cut-off rest of the
document before, or else the next unused document); the index returns the seed's best unused neighbours in order of their
scores, which fill the window greedily; the one that goes over is cut, and its rest seeds the next sequence.  So only the
last sequence of a shard can be short; it is cut into powers of two, which are not padded.

Shards bound what one task holds, and their number follows the documents.  No document or term is dropped.  Neighbours
are those of the shard: the nearer two documents are, the likelier they meet in one, but this isn't certain, and a
neighbour in another shard isn't found.  In a shard, neighbours without a common term come last, in order.

Rows: a null text counts as empty: one token, the end mark; repeated rows are packed each, null doc_ids too; other columns
are ignored; an empty table yields an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_number, gathered, keyed_texts, map_arrow, mix64, release, settled, text_bytes
from .word_bpe import ENCODED_BYTES, loaded

K1, B = 1.2, 0.75
#: Min-hashes of a document, 16 bits each.
KEYS = 4
#: A term in more than one of so many documents of a shard is common: its weights are kept for all of them.
COMMON = 32
#: So many weights of each common term are added up at once.
COLUMNS = 1024

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Corpus(NamedTuple):
    """What BM25 counts over all documents."""

    n: int
    mean: float
    df: np.ndarray  # by term, an id of 16 bits

    def idf(self) -> np.ndarray:
        return np.log1p((self.n - self.df + 0.5) / (self.df + 0.5))


def document_terms(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The number of documents that each term is in; bounds: of the documents among the tokens."""
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n, dtype=np.uint32 if n <= 1 << 16 else np.uint64), np.diff(bounds))
    pairs = np.sort(owner << 16 | tokens)
    fresh = np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]
    return np.bincount((pairs[fresh] & 0xFFFF).astype(np.int64), minlength=1 << 16)


def counted(docs: list[np.ndarray]) -> Corpus:
    """The statistics of documents that are a corpus of their own."""
    bounds = np.cumsum([0, *(len(d) for d in docs)])
    return Corpus(len(docs), bounds[-1] / max(len(docs), 1), document_terms(np.concatenate(docs), bounds))


def term_ranks(corpus: Corpus) -> np.ndarray:
    """For each min-hash the places of all terms in its order: by exponential draws whose rate is the square idf."""
    terms = np.arange(1 << 16, dtype=np.uint64)
    # terms of one document relate it to none
    rate = np.where(corpus.df > 1, corpus.idf() ** 2, 0) + 1e-12
    ranks = np.zeros((KEYS, 1 << 16), np.uint16)
    for k in range(KEYS):
        draw = (mix64(terms + np.uint64((k + 1) << 32)).astype(np.float64) + 1) / 2.0**64
        ranks[k, np.lexsort((terms, -np.log(draw) / rate))] = terms
    return ranks


def lexical_keys(tokens: np.ndarray, bounds: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The min-hashes of each document, the first in the highest bits, in the order of signed numbers."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    for r in ranks:
        out = out << np.uint64(16) | np.minimum.reduceat(r[tokens], bounds[:-1]).astype(np.uint64)
    return (out ^ np.uint64(1 << 63)).view(np.int64)


class ShardIndex:
    """BM25 postings of one shard of at most 65,536 documents, which score all its documents as neighbours of one."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus):
        n = len(docs)
        sizes = np.array([len(d) for d in docs], np.int64)
        # a posting for each pair of term and document, sorted by term
        keys = np.concatenate(docs).astype(np.uint32) << 16 | np.repeat(np.arange(n, dtype=np.uint32), sizes)
        keys.sort()
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        counts, keys = np.diff(np.append(at, len(keys))), keys[at]
        terms, of = (keys >> 16).astype(np.int32), (keys & 0xFFFF).astype(np.int32)
        norm = K1 * (1 - B + B * sizes / max(corpus.mean, 1))
        weights = (corpus.idf()[terms] * counts * (K1 + 1) / (counts + norm[of])).astype(np.float32)
        fresh = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])[: len(terms)])
        times = np.diff(np.append(fresh, len(terms)))
        # only terms of several documents make neighbours; those of many are kept as rows of all documents' weights
        self.n, self.of, self.weights = n, of, weights
        self.low, self.high = fresh, fresh + times
        many = np.flatnonzero(times * COMMON > n)
        self.row = np.full(len(fresh), -1, np.int32)
        self.row[many] = np.arange(len(many))
        rows = np.zeros((len(many), n), np.float32)
        for k, t in enumerate(many):
            rows[k, of[fresh[t] : fresh[t] + times[t]]] = weights[fresh[t] : fresh[t] + times[t]]
        # cut into parts of which what is added up at once stays in the cache
        self.parts = [np.ascontiguousarray(rows[:, low : low + COLUMNS]) for low in range(0, n, COLUMNS)]
        # the terms of each document
        place = np.repeat(np.arange(len(fresh), dtype=np.int32), times)
        use = np.repeat(times > 1, times)
        order = np.argsort(of[use], kind="stable")
        self.terms, self.bounds = place[use][order], np.searchsorted(of[use][order], np.arange(n + 1))

    def scores(self, seed: int) -> np.ndarray:
        terms = self.terms[self.bounds[seed] : self.bounds[seed + 1]]
        rows = self.row[terms]
        common = rows[rows >= 0]
        out = np.concatenate([part.take(common, axis=0).sum(axis=0, dtype=np.float32) for part in self.parts])
        for t in terms[rows < 0]:
            k = slice(self.low[t], self.high[t])
            out[self.of[k]] += self.weights[k]  # a document is in a list once
        return out


def fill(docs: list[np.ndarray], window: int, corpus: Corpus | None = None) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of all pieces of one shard; a shard without a corpus is its own."""
    index = ShardIndex(docs, corpus or counted(docs))
    unused = np.ones(len(docs), bool)
    out: list[tuple[int, int, int, int, int]] = []
    sequence, room, fresh, done = 0, window, 0, 0
    score: np.ndarray | None = None

    def put(doc: int) -> None:
        """All of the document."""
        nonlocal sequence, room
        start, size = 0, len(docs[doc])
        while start < size:
            length = min(room, size - start)
            out.append((doc, start, length, sequence, window - room))
            start, room = start + length, room - length
            if room == 0:
                sequence, room = sequence + 1, window
        unused[doc] = False

    while done < len(docs):
        if score is None:
            # a new sequence: its seed is the document that was cut, else the next one
            if room == window:
                while not unused[fresh]:
                    fresh += 1
                seed = fresh
                put(seed)
                done += 1
            if done == len(docs):
                break
            score = np.where(unused, index.scores(seed), np.float32(-1))
        doc = int(score.argmax())
        score[doc] = -1
        before = sequence
        put(doc)
        done += 1
        if sequence != before:
            seed, score = doc, None
    return out


def last_split(pieces: list[tuple[int, int, int, int, int]], window: int) -> list[tuple[int, int, int, int, int]]:
    """The short last sequence cut into powers of two, the largest first: none of them needs padding."""
    if not pieces:
        return pieces
    last = pieces[-1][3]
    size = sum(p[2] for p in pieces if p[3] == last)
    if size == window:
        return pieces
    cuts = [int(x) for x in np.cumsum([1 << k for k in range(window.bit_length(), -1, -1) if size >> k & 1])]
    edges = [0, *cuts]
    out = [p for p in pieces if p[3] != last]
    for doc, start, length, _, offset in (p for p in pieces if p[3] == last):
        for k, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
            a, b = max(low, offset), min(high, offset + length)
            if a < b:
                out.append((doc, start + a - offset, b - a, last + k, a - low))
    return out


def encoded(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id and ids (16 bits each, with the end mark) of every document."""
    end = np.array([end_id], "<u2").tobytes()

    def make():
        bpe = loaded(vocabulary)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = pc.binary_join_element_wise(bpe.encode_column(batch.column(1)), *(pa.scalar(x, pa.large_binary()) for x in (end, b"")))
            return pa.RecordBatch.from_arrays([batch.column(0), ids.cast(pa.binary())], ["doc_id", "ids"])

        return work

    return map_arrow(keyed_texts(docs), make, "doc_id long, ids binary", ENCODED_BYTES)


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of a column of ids, and the documents' bounds in them."""
    raw, bounds = text_bytes(column.cast(pa.large_binary()).view(pa.large_string()))
    return raw.view("<u2"), bounds // 2


def corpus_of(coded: DataFrame) -> Corpus:
    """The statistics over all documents; the driver gets a row for each term of the vocabulary."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            tokens, bounds = tokens_of(batch.column(1))
            df = document_terms(tokens, bounds)
            terms = np.flatnonzero(df)
            # two more rows: the numbers of documents and of tokens
            return pa.RecordBatch.from_arrays([pa.array(np.append(terms, [-1, -2])), pa.array(np.append(df[terms], [batch.num_rows, len(tokens)]))], ["term", "n"])

        return work

    table = map_arrow(coded, make, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    found = dict(zip(table["term"].to_pylist(), table["n"].to_pylist(), strict=True))
    df = np.zeros(1 << 16, np.int64)
    n, tokens = found.pop(-1, 0), found.pop(-2, 0)
    df[list(found)] = list(found.values())
    return Corpus(n, tokens / max(n, 1), df)


def in_order(coded: DataFrame, corpus: Corpus) -> DataFrame:
    """doc_id and ids, sorted by lexical keys."""
    shared = coded.sparkSession.sparkContext.broadcast(term_ranks(corpus))

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys = lexical_keys(*tokens_of(batch.column(1)), shared.value)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys)], ["doc_id", "ids", "key"])

        return work

    keyed = map_arrow(coded, make, "doc_id long, ids binary, key long")
    return keyed.orderBy("key", "doc_id", F.xxhash64("ids")).select("doc_id", "ids")


def packed_shard(rows: pa.Table, window: int, corpus: Corpus, first_sequence: int) -> tuple[pa.RecordBatch, int]:
    """The pieces of a shard's documents and the number of its sequences."""
    coded = [np.frombuffer(x, "<u2") for x in rows.column("ids").to_pylist()]
    pieces = last_split(fill(coded, window, corpus), window)
    crc = [zlib.crc32(coded[d][s : s + n].astype("<u4").tobytes()) for d, s, n, _, _ in pieces]
    doc, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
    sizes = np.array([len(x) for x in coded], np.int64)
    columns = [rows.column("doc_id").combine_chunks().take(pa.array(doc)), start, length, np.array(crc, np.int64), sizes[doc], first_sequence + sequence, offset]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split(" ")[0] for c in PIECES.split(", ")]), int(sequence.max()) + 1


def pack(docs: DataFrame, window: int = 2048, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, shard_docs: int = 5000, shard_bytes: int = 1 << 23) -> DataFrame:
    """One row for each piece of a document, with its place in a sequence."""
    spark = docs.sparkSession
    coded = settled(encoded(docs, vocabulary, end_id), "packing-ids")
    corpus = corpus_of(coded)
    if corpus.n == 0:
        return spark.createDataFrame([], PIECES)
    shared = spark.sparkContext.broadcast(corpus)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequences = 0
        try:
            # the task's rows come in order, so a shard is what follows one another
            for shard in gathered(batches, shard_bytes, shard_docs):
                pieces, n = packed_shard(shard, window, shared.value, block_number(0) + sequences)
                sequences += n
                yield pieces
        finally:
            release()

    return in_order(coded, corpus).mapInArrow(run, PIECES)
