"""Exact, near and span deduplication against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex

from screenmill.llm import exact_dedup, minhash_dedup, repeated_spans

ROWS = [(1, "a b"), (2, "a b"), (9, "a b "), (4, None), (5, ""), (6, "x"), (6, "x"), (None, "x"), (None, "solo"), (7, "long " * 20000), (8, "long " * 20000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, keep_id string")


def test_exact_groups(spark):
    got = sorted(((r.doc_id or 0, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(frame(spark, ROWS)).collect()), key=repr)
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[t or ""].append(i)
    want = []
    for i, t in ROWS:
        own = groups[t or ""]
        keep = max((x for x in own if x is not None), default=None)
        want.append((i or 0, keep, len(own), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert exact_dedup.exact_groups(frame(spark, []).limit(0)).count() == 0


def test_quotient_filter_is_lossless():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 1 << 63, 500).astype(np.uint64) for _ in range(3)]
    parts[1][:50] = parts[0][:50]
    filters = [exact_dedup.QuotientFilter.from_bytes(exact_dedup.QuotientFilter.of(p, np.ones(500, np.int64), 20).to_bytes()) for p in parts]
    whole = exact_dedup.QuotientFilter.merged(filters)
    want = Counter(np.concatenate(parts).tolist())
    assert dict(zip(whole.fingerprints().tolist(), whole.counts.tolist(), strict=True)) == want
    cut = [f for _, f in whole.shards(4)]
    assert sorted(x for f in cut for x in f.fingerprints().tolist()) == sorted(want)


def shingle_counts(text):
    w = regex.findall(r"[a-z0-9\x80-\U0010ffff]+", regex.sub(r"[A-Z]+", lambda m: m[0].lower(), text or ""))
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(texts):
    counts = {i: shingle_counts(t) for i, t in texts.items()}
    where = defaultdict(list)
    for i, c in counts.items():
        for s in c:
            where[s].append(i)
    shared = Counter()
    for s, own in where.items():
        for x in range(len(own)):
            for y in range(x):
                shared[own[y], own[x]] += min(counts[own[y]][s], counts[own[x]][s])
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in shared.items():
        if n >= 0.8 * (counts[a].total() + counts[b].total() - n):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: find(i) for i in texts}


def varied(rng, words, share):
    return " ".join(rng.choice(VOCABULARY) if rng.random() < share else w for w in words)


VOCABULARY = ["w%d" % k for k in range(900)]


@pytest.mark.parametrize("block", [1000, 7])
def test_near_groups_equal_brute_force(spark, monkeypatch, block):
    """A hundred variants of one text, of which many are just below or above the bound, and unrelated texts; also in small blocks."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    rng = random.Random(3)
    base = [rng.choice(VOCABULARY) for _ in range(150)]
    texts = {k: varied(rng, base, rng.choice([0.0, 0.01, 0.02, 0.03, 0.05])) for k in range(100)}
    texts |= {100 + k: " ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(1, 80))) for k in range(40)}
    texts |= {200: "", 201: None, 202: "...", 203: "One two", 204: "one, TWO!", 205: "one"}
    got = {r.doc_id: r.class_id for r in minhash_dedup.near_groups(frame(spark, list(texts.items()))).collect()}
    assert got == brute_classes(texts)


def test_links_of_a_block_join_without_a_row_for_each_pair(spark):
    words = [f"v{k}" for k in range(60)]
    rows = [(0, k, k // 2 if k < 10 else k, role, 0, 0, " ".join([*words[: 59 if k < 40 else 20], f"end{k}"])) for k in range(50) for role in "qi"]
    links = minhash_dedup.linked_in_blocks(spark.createDataFrame(rows, "leader long, doc_id long, root long, role string, q int, i int, text string"), 1, 80).collect()
    roots = {r[2] for r in rows}
    top = {k: k for k in roots}
    for a, b in sorted((r.a, r.b) for r in links):
        top = {k: top[a] if t == top[b] else t for k, t in top.items()}
    groups = Counter(Counter(top.values()).values())
    assert groups == {35: 1, 10: 1} and len(links) == len(roots) - 2  # 1,280 rows and more with one for each pair


def test_near_groups_of_one_id_with_two_texts(spark):
    rng = random.Random(5)
    one, other = ([rng.choice(VOCABULARY) for _ in range(80)] for _ in range(2))
    rows = [(1, " ".join(one)), (7, " ".join([*one[:-1], "end"])), (7, " ".join(other)), (8, " ".join([*other[:-1], "end"])), (8, " ".join([*other[:-1], "end"])), (None, " ".join(one)), (9, "")]
    got = sorted(((r.doc_id or 0, r.class_id or 0, r.kept) for r in minhash_dedup.near_groups(frame(spark, rows)).collect()))
    assert got == [(0, 0, True), (1, 1, True), (7, 1, False), (7, 7, True), (8, 7, False), (8, 7, False), (9, 9, True)]


def test_near_groups_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.class_id, r.kept) for r in minhash_dedup.near_groups(docs).collect()}
    want = brute_classes({r.doc_id: r.text for r in docs.collect()})
    assert got == {i: (c, i == c) for i, c in want.items()}
    assert minhash_dedup.near_groups(docs.limit(0)).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    b = np.concatenate([a[:300], a[:100], rng.integers(0, 1 << 63, 50).astype(np.uint64)])
    ca, cb = Counter(a.tolist()), Counter(b.tolist())
    real = (ca & cb).total() / (ca | cb).total()
    hits = []
    for seed in range(30):
        mixed = minhash_dedup.mix64(np.concatenate([a, b]) + np.uint64(seed) * np.uint64(77))
        s = minhash_dedup.signatures(mixed, np.array([0, len(a), len(a) + len(b)]))
        hits.append((s[0] == s[1]).mean())
    assert abs(np.mean(hits) - real) < 0.03


def brute_spans(rows):
    order = sorted({i for i, _ in rows})
    seen, out = set(), {}
    for i in order:
        fresh = set()
        for k, (j, t) in enumerate(rows):
            if j != i:
                continue
            b = (t or "").encode()
            gone = bytearray(len(b))
            for p in range(len(b) - 49):
                if b[p : p + 50] in seen:
                    gone[p : p + 50] = b"\1" * 50
                fresh.add(b[p : p + 50])
            kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
            spans = sum(1 for x in range(len(b)) if gone[x] and (x == 0 or not gone[x - 1]))
            out[k] = (i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
        seen |= fresh
    return sorted(out.values())


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_spans_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcé \n") for _ in range(rng.randint(40, 160))) for _ in range(6)] + ["ab" * 40, "z" * 130, "x" * 49]
    rows = []
    for i in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(0, 90))) for _ in range(rng.randint(0, 6))]
        rows.append((i, "".join(p[rng.randint(0, 3) :] for p in parts)))
    rows += [(70, None), (71, ""), (72, "z" * 130), (72, "z" * 200), (5, "z" * 130)]
    got = sorted(map(tuple, repeated_spans.remove_repeats(frame(spark, rows), block_bytes=2000).collect()))
    assert got == brute_spans(rows)


@pytest.mark.parametrize("route", ["phrases", "strings"])
def test_spans_of_long_texts_and_hot_triggers(spark, route):
    """Texts over 100 kB and over one piece, a passage after other words in every text; all triggers by either route."""
    rng = random.Random(7)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage, long = letters(400), letters(1_150_000)
    rows = [(k, letters(20) + passage + letters(rng.randint(0, 60))) for k in range(80)]
    rows += [(90, long), (91, letters(77) + long[1_000_000:1_100_000] + letters(5)), (92, long[:120_000] + passage + long[1_048_500:1_048_700])]
    raw = "".join(t for _, t in rows[:40]).encode()
    every = np.unique(repeated_spans.Phrases(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).trigger)
    got = sorted(map(tuple, repeated_spans.remove_repeats(frame(spark, rows), hot=every if route == "strings" else every[:0], block_bytes=20_000).collect()))
    assert got == brute_spans(rows)


def test_suffix_order_is_that_of_the_bytes():
    rng = np.random.default_rng(4)
    raw = rng.integers(97, 99, 4000).astype(np.uint8)
    raw[1000:1200] = raw[:200]
    starts = np.arange(len(raw) - 49)
    order, rank = repeated_spans.suffix_order(raw, starts)
    strings = [raw[k : k + 50].tobytes() for k in starts]
    assert [strings[k] for k in order] == sorted(strings)
    assert len(set(rank.tolist())) == len(set(strings))


def test_hot_triggers_are_found(spark):
    rng = random.Random(8)
    passage = "a passage of more than fifty bytes that many texts share, after other words"
    rows = [(k, "".join(rng.choice("abcdefghijklmnop") for _ in range(60)) + passage) for k in range(900)]
    blocks = repeated_spans.packed_blocks(frame(spark, rows).select("doc_id", "text"), 1 << 22)
    assert len(repeated_spans.hot_triggers(blocks, 500)) > 0
    assert len(repeated_spans.hot_triggers(blocks, 5000)) == 0


def test_spans_carry_columns_and_null_ids(spark):
    long = "q" * 30 + "the same passage that is long enough to be found twice, é" + "r" * 30
    rows = spark.createDataFrame([(None, long, "n"), (2, long, "two"), (1, long, "one"), (3, "short", "s")], "doc_id long, text string, lang string")
    got = {r.lang: (r.doc_id, r.text) for r in repeated_spans.remove_repeats(rows, carried=["lang"]).collect()}
    assert got == {"one": (1, long), "two": (2, ""), "n": (None, ""), "s": (3, "short")}
    assert repeated_spans.remove_repeats(rows.limit(0)).count() == 0
