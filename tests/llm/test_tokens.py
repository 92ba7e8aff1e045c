"""Tokens against the libraries, on random and real texts."""

from __future__ import annotations

import base64
import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from screenmill.llm import byte_bpe, packing, word_bpe

PARTS = st.sampled_from(["<|endoftext|>", "<|startoftext|>", "'s", "'LL", " ", "  ", "\n", "\n ", "aaaaaaa", "Ünïcode", "ΣΑΣ", "é", "한국어", "🙂", "123", "#$%", "the ", "\x1c", "\xa0", "İ", "ß"])
#: Characters that Unicode has assigned for long: libraries differ on the newest ones.
CHARACTERS = st.characters(exclude_categories=("Cn", "Cs"))
TEXTS = st.lists(st.one_of(PARTS, st.text(CHARACTERS, max_size=6)), max_size=12).map("".join)


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def byte_library():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=TEXTS)
def test_word_ids(word_library, text):
    got = np.frombuffer(word_bpe.loaded("word_bpe_49k.json").encode([text])[0], "<u2").tolist()
    assert got == word_library.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(texts=st.lists(TEXTS, max_size=6), most=st.sampled_from([1, 5, 50]))
def test_word_ids_of_columns_with_a_table_that_overflows(word_library, texts, most):
    """Texts of a column, twice, cut out of a larger one; chunks of zero bytes and long ones aren't kept."""
    bpe = word_bpe.loaded("word_bpe_49k.json")
    before, bpe.kept = bpe.kept, word_bpe.ChunkTable(most)
    texts = ["before", *texts, "", " a\0 a \0 b\0\0 a", "\u2029Ünïcode" * 9, "x" * 32, "x" * 33, "y\0" * 16, "it's 'tis don't!! 12³ a'sb'", "after"]
    try:
        for _ in range(2):
            got = bpe.encode_column(pa.array(texts).slice(1, len(texts) - 2)).to_pylist()
            assert [np.frombuffer(x, "<u2").tolist() for x in got] == [word_library.encode(t, add_special_tokens=False).ids for t in texts[1:-1]]
    finally:
        bpe.kept = before
    assert bpe.encode_column(pa.array([], pa.string())).to_pylist() == bpe.encode([]) == []


def test_a_chunk_is_merged_once(monkeypatch):
    """More chunks than two full caches of 6 MB held: in a second pass none is merged again."""
    rng = np.random.default_rng(3)
    letters = rng.integers(97, 123, (250_000, 24), np.uint8)
    letters[:, 23] = 32
    texts = [part.tobytes().decode() for part in np.array_split(letters, 10)]
    bpe = word_bpe.loaded("word_bpe_49k.json")
    first = [bpe.encode([t]) for t in texts]
    merged = []
    merge = word_bpe.WordBpe.merge
    monkeypatch.setattr(word_bpe.WordBpe, "merge", lambda *args: merged.append(1) or merge(*args))
    assert [bpe.encode([t]) for t in texts] == first and not merged


@settings(max_examples=300, deadline=None)
@given(text=TEXTS)
def test_byte_ids_round_trip(byte_library, text):
    n, ids, data = byte_bpe.loaded("byte_bpe_50k.tiktoken").encode(text)
    want = byte_library.encode_ordinary(text)
    assert ([*map(int, ids.split())], n, data) == (want, len(want), text.encode())


def test_long_runs(byte_library):
    bpe = byte_bpe.loaded("byte_bpe_50k.tiktoken")
    for text in ("a" * 5000, " " * 5000, "ab" * 3000, "=" * 999):
        assert [*map(int, bpe.encode(text)[1].split())] == byte_library.encode_ordinary(text)


ROWS = [(1, "Hello the world"), (2, None), (3, ""), (3, ""), (None, "x y"), (5, "word " * 3000)]


def test_operators_and_edges(spark, word_library, byte_library):
    docs = spark.createDataFrame([(i, t, "n_tokens") for i, t in ROWS], "doc_id long, text string, n_tokens string")
    counts = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in word_bpe.token_counts(docs).collect())
    want = sorted((i or 0, len((t or "").encode()), n := len(word_library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in ROWS)
    assert counts == want
    coded = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.encode_decode(docs).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert coded == sorted((i or 0, len(x := byte_library.encode_ordinary(t or "")), sha(" ".join(map(str, x)).encode()), sha((t or "").encode())) for i, t in ROWS)
    assert word_bpe.token_counts(docs.limit(0)).count() == 0


def check_packing(rows, texts, library):
    """Every id lies in exactly one piece, pieces fill their sequences without gaps, and nothing needs padding."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc_id, text in texts.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(docs[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0


def test_packing(spark, word_library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(10_000, None), (10_001, ""), (10_002, "long " * 9000)], "doc_id long, text string")
    every = docs.unionByName(extra)
    check_packing(packing.pack(every, shard_docs=60).collect(), {r.doc_id: r.text for r in every.collect()}, word_library)
    assert packing.pack(every.limit(0)).count() == 0


def test_neighbours_share_words():
    rng = np.random.default_rng(0)
    topics = [rng.integers(100 * k, 100 * k + 60, (30, 200)) for k in range(4)]
    docs = [np.append(d, 1).astype("<u2") for t in zip(*topics, strict=True) for d in t]
    pieces = packing.fill(docs, 2048)
    together = defaultdict(set)
    for doc, _, _, sequence, _ in pieces:
        together[sequence].add(doc % 4)
    assert np.mean([len(t) for t in together.values()]) < 2.2  # mixed at random it would be nearly 4


def test_related_documents_meet_in_a_shard(spark):
    rng = np.random.default_rng(1)
    # 40 topics of words of their own, each on 10 documents that a hash would deal to ten shards at random
    words = [[f"{a}{b}{c}{d}ing" for a, b, c, d in rng.choice(list("bcdfglmnprst"), (40, 4))] for _ in range(40)]
    rows = [(k, " ".join(rng.choice(words[k % 40], 120))) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    coded = packing.encoded(docs, "word_bpe_49k.json", 1)
    corpus = packing.corpus_of(coded)
    texts = [np.frombuffer(r.ids, "<u2") for r in coded.collect()]
    assert corpus.n == 400 and corpus.mean == np.mean([len(d) for d in texts])
    assert np.array_equal(corpus.df, packing.counted(texts).df)
    order = [r.doc_id for r in packing.in_order(coded, corpus).collect()]
    shards = {k: set(order[k : k + 40]) for k in range(0, 400, 40)}
    pairs = [a % 40 == b % 40 for s in shards.values() for a in s for b in s if a < b]
    # of 1800 pairs of a topic a tenth would meet at random
    assert sum(pairs) > 0.4 * 1800


def test_copies_and_equal_rows_are_packed_each(spark, word_library):
    docs = spark.createDataFrame([(None, "the same text again and again")] * 50 + [(7, "another")] * 2 + [(8, None)], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    rows = packing.pack(docs, shard_docs=10).collect()
    size = {text: len(word_library.encode(text or "", add_special_tokens=False).ids) + 1 for text in ("the same text again and again", "another", None)}
    assert sum(r.length for r in rows) == 50 * size["the same text again and again"] + 2 * size["another"] + size[None]
    assert sum(r.length for r in rows if r.doc_id is None) == 50 * size["the same text again and again"]
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    assert all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) for a, b in zip(places, places[1:], strict=False))


def test_neighbours_equal_plain_bm25():
    """The scores by the formula, document by document, and the order in which a window takes its neighbours."""
    rng = np.random.default_rng(5)
    docs = [np.append(rng.integers(0, 300, rng.integers(5, 60)), 1).astype("<u2") for _ in range(40)]
    corpus = packing.counted(docs)
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = {t: sum(t in d for d in docs) for t in range(300)}

    def score(seed, doc):
        total = 0.0
        for t in set(docs[seed].tolist()):
            tf = int((docs[doc] == t).sum())
            if tf:
                total += math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(docs[doc]) / mean))
        return total

    index = packing.ShardIndex(docs, corpus)
    got = np.array([index.scores(k) for k in range(n)])
    own = [max(score(k, k) for k in range(n))]
    assert all(abs(got[a, b] - score(a, b)) < 1e-3 * own[0] for a in range(n) for b in range(n) if a != b)
    pieces = packing.fill(docs, 100_000, corpus)
    assert [p[0] for p in pieces] == [0, *sorted(range(1, n), key=lambda k: (-np.float32(got[0, k]), k))]


def test_a_shard_is_bounded_by_bytes(spark):
    docs = spark.createDataFrame([(k, f"word{k} " * 3000) for k in range(12)], "doc_id long, text string")
    rows = packing.pack(docs.coalesce(1), shard_bytes=20_000).collect()
    sequences = defaultdict(set)
    for r in rows:
        sequences[r.doc_id].add(r.sequence_id)
    assert len(set.union(*sequences.values())) > 12 and sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
