"""Filter audit, manifest and archives against brute force, with nulls, ties, repeated rows and empty tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from screenmill.llm import common, filter_audit, manifest, warc

WORDS = "w1 w2 w3 w4 W5 w6 w7"
LONG = " ".join(f"w{k}" for k in range(210))
AUDIT_ROWS = [
    (1, LONG, "s"), (2, LONG, "s"), (2, LONG, "s"), (3, LONG, None), (4, LONG + " #", ""), (5, None, "t"), (6, "", "t"), (7, "ABC " * 300, "t"), (8, "ABC " * 300, None),
    (None, LONG, "s"), (None, "alone", "s"), (9, "x y | z", "s"), (9, "Other", "s"), (10, " \t\n", "u"), (11, "a" * 200_000, "u"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (4, 1, None), (7, None, 1), (None, 1, 1), (99, 1, 1), (9, 1, 0)]


def brute_audit(rows, labels):
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    parts = defaultdict(list)
    for i, t, p in rows:
        text = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and first[text] < i}
        parts[p or ""].append(({k for k, v in fails.items() if v}, i in good, i in toxic))
    out, shapley = [], Counter()
    for p, docs in parts.items():
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[p, f] += len(gone)
                out.append([p, "".join(order), step + 1, len(left), len(gone), sum(f in d[0] for d in docs) - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)])
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


@pytest.mark.parametrize("shuffled", [False, True])
def test_audit(spark, monkeypatch, shuffled):
    if shuffled:
        monkeypatch.setattr(common, "BROADCAST_GROUPS", -1)
        monkeypatch.setattr(common, "HOT_GROUPS", 4)
        monkeypatch.setattr(filter_audit, "BROADCAST_ROWS", -1)
    docs = spark.createDataFrame([(*r, "x") for r in AUDIT_ROWS], "doc_id long, text string, source string, part string")
    labels = spark.createDataFrame([(*r, "y") for r in LABELS], "doc_id long, quality int, toxic int, text string")
    got = filter_audit.audit(docs, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(AUDIT_ROWS, LABELS)
    if not shuffled:
        assert filter_audit.audit(docs.limit(0), labels).count() == 0
        assert {r.good_lost for r in filter_audit.audit(docs, labels.limit(0)).collect()} == {0}


def test_removal_intervals():
    for n in (1, 3, 5):
        orders = list(permutations(range(n)))
        for mask in range(1 << n):
            got = {}
            for step, low, high in filter_audit.removal_intervals(n, mask):
                for rank in range(low, high):
                    assert rank not in got
                    got[rank] = step
            want = {rank: next(k + 1 for k, f in enumerate(o) if mask >> f & 1) for rank, o in enumerate(orders)} if mask else {}
            assert got == want


def test_own_filters(spark):
    two = (filter_audit.Filter("S", lambda text, words: F.char_length(text) < 3), filter_audit.Filter("N", lambda text, words: F.size(words) == 0))
    docs = spark.createDataFrame([(1, "ab", "p"), (2, "", "p"), (3, "long enough", "p")], "doc_id long, text string, source string")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails) for r in filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), two).collect()}
    assert got == {("SN", 1): (1, 2, 0, 1), ("SN", 2): (1, 0, 1, 0), ("NS", 1): (2, 1, 0, 0), ("NS", 2): (1, 1, 1, 1)}


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_tree(nodes):
    """The root and each node's siblings from the bottom up, as (left, right)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            run = nodes[p // 8 * 8 : p // 8 * 8 + 8]
            paths[k].append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
        nodes = [h("".join(nodes[k : k + 8])) for k in range(0, len(nodes), 8)]
        at = [p // 8 for p in at]
    return nodes[0], paths


def brute_manifest(rows):
    def leaf(r):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    groups = defaultdict(list)
    for r in rows:
        low = r[4] and re.sub("[A-Z]+", lambda m: m[0].lower(), r[4])
        due = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), leaf((*r[:4], low)) if due else leaf(r), r[0]))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: brute_tree([x[2] for x in sorted(groups[g])]) for g in order}
    root, above = brute_tree([trees[g][0] for g in order])
    out = []
    for g, over in zip(order, above, strict=True):
        for x, path in zip(sorted(groups[g]), trees[g][1], strict=True):
            node = x[3]
            for a, b in path + over:
                node = h(a + node + b)
            out.append((x[4], x[2], trees[g][0], root, h("".join(a + b for a, b in path + over)), node, node == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shuffled", [False, True])
def test_manifest(spark, monkeypatch, shuffled):
    if shuffled:
        monkeypatch.setattr(manifest, "BROADCAST_NODES", -1)
        monkeypatch.setattr(manifest, "BROADCAST_RUNS", -1)
        monkeypatch.setattr(manifest, "LEVELS", 1)
    rng = random.Random(3)
    rows = [(rng.randrange(900) if k % 50 else None, rng.choice(["s", None, ""]), rng.choice(["en"] * 9 + ["de", "", None]), rng.choice([None, 7]), rng.choice(["Aé", "B" * 9, "", None, "low"])) for k in range(700)]
    rows += [(5, "s", "one", 1, "Only"), (12, "s", "é", 1, "ÄZ" * 50_000), *[(6, "s", "same", 1, "Twice")] * 9]
    docs = spark.createDataFrame([(*r, "h") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, hash string")
    got = manifest.manifest(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_manifest(rows)


def test_small_manifests(spark):
    docs = spark.createDataFrame([(3, None, None, None, None)], "doc_id long, source string, lang string, n_chars long, text string")
    only = manifest.manifest(docs).first()
    assert only.leaf == only.subroot == only.root == only.folded_root == h("1:3----") and only.proof_sha256 == h("") and only.verified
    assert manifest.manifest(docs.limit(0)).count() == 0


PAGES = [
    (1, "https://a.example/x?q=1", "<p>é</p>"), (2, "https://a.example/x?q=1", "<p>é</p>"), (3, None, "<p>é</p>"), (4, "http://b.example:80/y#z", None), (5, "", ""), (6, "no url", "other"), (7, "https://a.example/x", "a\r\n\r\nb" * 9),
    (8, "https://u@A.example./x", "long " * 100_000), (8, "https://u@A.example./x", "long " * 100_000), (None, "https://a.example/n", "<p>é</p>"), (None, None, "lone"), (None, "line\nbreak\x85 ", "lone"), (9, "https://c.example/" + "k" * 500, "deep"),
]


def brute_records(rows, least=0):
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = []
    for i, _, t in rows:
        data = (t or "").encode()
        to = first.get(t or "")
        to = None if to == i or len(data) < least else to
        out.append((i, len(data), warc.base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


def of_records(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


@pytest.mark.parametrize("least", [0, 7])
def test_archives(spark, tmp_path, monkeypatch, least):
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    monkeypatch.setattr(warc, "PART_CAPTURES", 3)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    pages = spark.createDataFrame([(*r, "f") for r in PAGES], "page_id long, url string, html string, file string").repartition(2)
    folder = f"file:{tmp_path}/w"
    captures = warc.write_archives(pages, folder, least)
    index = warc.build_index(captures, f"{folder}-index")
    assert len(index.parts) > 2 and [p[3] for p in index.parts] == sorted(p[3] for p in index.parts)
    keys = pages.select(warc.key_of(F.col("url")).alias("key"))
    found = warc.locate(index, keys)
    assert found.count() == len(PAGES)
    assert of_records(warc.fetch(found, folder)) == brute_records(PAGES, least)
    assert of_records(warc.scan_archives(spark, folder)) == brute_records(PAGES, least)
    by_id = {(r.page_id, r.record_type): r for r in warc.fetch(found, folder).collect()}
    assert all(r.intact for r in by_id.values())
    assert bytes(by_id[7, "response"].payload).decode() == PAGES[6][2] and by_id[7, "response"].url == PAGES[6][1]
    assert by_id[3, "revisit" if least <= 9 else "response"].url is None
    # a key gives all its captures, an unknown one none
    some = spark.createDataFrame([("example,a)/x",), ("example,a)/x",), ("zzz",), ("",), ("example,a)/x?q=1",)], "key string")
    assert Counter(r.page_id for r in warc.locate(index, some).collect()) == Counter([7, 8, 8, 3, 5, None, 1, 2])


def test_keys(spark):
    urls = {"https://user@Sub.Example.COM:8080/A/b?c#d": "com,example,sub)/A/b?c", "http://example.com": "com,example)", "no url": "no%20url", "": "", None: ""}
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", warc.key_of(F.col("url")).alias("key"))
    assert {r.url: r.key for r in rows.collect()} == urls


def test_empty_archives(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archived(pages).count() == 0
    one = spark.createDataFrame([(1, "https://a.example/", "x")], "page_id long, url string, html string")
    assert of_records(warc.archived(one)) == brute_records([(1, "", "x")])
