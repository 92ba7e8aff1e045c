"""The pipeline stage by stage against what each operator says of the stage's own input, and against brute force."""

from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_dedup import brute_classes
from test_tokens import check_packing
from tokenizers import Tokenizer

from screenmill.llm import common
from screenmill.llm.toxicity import toxicity

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
ONE, OTHER = ("the first text of some length that is told apart by all of its words and numbers %d" % k for k in (1, 2))


def left_texts(rows):
    """What is left of each text (of rows with different ids) when strings of 50 bytes that a smaller id has are cut out."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if b[p : p + 50] in seen:
                gone[p : p + 50] = b"\1" * 50
        seen |= {b[p : p + 50] for p in range(len(b) - 49)}
        out[i] = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode(errors="ignore")
    return out


def test_stages(spark):
    docs = common.documents(spark, SF)
    columns = docs.columns
    (_, toxic), (_, exact), (_, near), (_, spans), (_, packing) = corpus_pipeline.STAGES

    def step(stage, before):
        after = common.settled(stage(spark, before, SF), "test")
        assert after.columns == columns and after.dtypes == docs.dtypes
        return after

    clean = step(toxic, docs)
    bad = {r.doc_id for r in toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 1").collect()}
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(clean) == ids(docs) - bad
    once = step(exact, clean)
    texts = {r.doc_id: r.text for r in clean.collect()}
    last = {t: max(i for i, x in texts.items() if x == t) for t in set(texts.values())}
    assert ids(once) == set(last.values())
    single = step(near, once)
    classes = brute_classes({i: texts[i] for i in ids(once)})
    assert ids(single) == {i for i, c in classes.items() if i == c}
    cut = step(spans, single)
    rows = cut.collect()
    assert {r.doc_id: r.text for r in rows} == left_texts([(r.doc_id, r.text) for r in single.collect()])
    assert all(r.n_chars == len(r.text) for r in rows)
    check_packing(packing(spark, cut, SF).collect(), {r.doc_id: r.text for r in rows}, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    # the whole run packs the same documents
    whole = defaultdict(int)
    for r in corpus_pipeline.run(spark, SF).collect():
        whole[r.doc_id] += r.length
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert whole == {r.doc_id: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in rows}


def frame(spark, rows):
    """Rows (doc_id, text) with the columns of documents and others whose names the operators use."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clash = ("keep_id", "block", "node", "text_hash", "kept", "ids", "carried_0", "score", "_hash", "hash", "id", "row", "a.b", "t`k")
    return docs.select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.char_length("text").alias("n_chars"), *(F.lit(f"own {c}").alias(c) for c in clash))


@pytest.fixture
def folder(spark, tmp_path):
    """A folder of labels: two toxic rows and two others, whatever the documents are."""
    spark.createDataFrame([(k, 0, int(k < 2)) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def contents(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_exact_stage_keeps_every_text_once(spark, folder):
    rows = [(5, ONE), (9, ONE), (5, OTHER), (5, OTHER), (None, ONE), (None, "solo"), (None, "solo"), (7, None), (8, ""), (3, "x")]
    docs = frame(spark, rows)
    left = STAGES["exact dedup"](spark, docs, folder)
    assert left.columns == docs.columns
    assert contents(left) == Counter([(9, ONE), (5, OTHER), (None, "solo"), (8, ""), (3, "x")])
    assert all(r[c] == f"own {c}" for r in left.collect() for c in ("keep_id", "_hash", "hash", "row", "a.b", "t`k"))


def test_near_stage_drops_rows_by_their_own_text(spark, folder):
    long = lambda t: " ".join(f"{t} {k}" for k in range(12))
    rows = [(1, long(ONE)), (7, long(ONE) + " end"), (7, long(OTHER).replace("text", "tale")), (8, ""), (8, None), (None, long(ONE)), (4, "short")]
    docs = frame(spark, rows)
    left = STAGES["MinHash near-dedup"](spark, docs, folder)
    assert left.columns == docs.columns
    assert contents(left) == Counter([rows[0], rows[2], rows[3], rows[4], rows[5], rows[6]])


def test_toxic_stage_drops_rows_by_their_own_text(spark, folder):
    plain, bad = "people met to talk about the report and the weather of the day", "you are a stupid moron and a worthless idiot"
    rows = [(k, bad if k < 2 else plain) for k in range(40)] + [(50, None), (50, ""), (None, plain), (60, plain), (60, bad), (60, bad)]
    docs = frame(spark, rows)
    verdicts = {(r.doc_id, r.text): r.score for r in toxicity_with_text(spark, docs, folder)}
    left = STAGES["toxicity"](spark, docs, folder)
    assert left.columns == docs.columns
    assert contents(left) == Counter(r for r in rows if verdicts[r] < 0.7)
    assert (60, plain) in contents(left)


def toxicity_with_text(spark, docs, folder):
    from screenmill.llm.toxicity import toxic_rows

    scores = toxic_rows(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    hashed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    same = scores["doc_id"].eqNullSafe(hashed["doc_id"]) & (scores["text_hash"] == hashed["h"])
    return scores.join(hashed, same).select(hashed["doc_id"], "text", "score").distinct().collect()


def test_spans_stage_and_packing_of_odd_rows(spark, folder):
    rows = [(1, ONE), (2, "é" + ONE + "é"), (3, None), (4, ""), (None, ONE), (5, OTHER), (5, OTHER), (6, OTHER)]
    docs = frame(spark, rows)
    cut = STAGES["suffix-array dedup"](spark, docs, folder)
    assert cut.columns == docs.columns
    left = left_texts([(1, ONE), (2, rows[1][1]), (3, None), (4, ""), (5, OTHER)])
    gone = left_texts([(1, ONE), (2, rows[1][1]), (5, OTHER), (6, OTHER), (1 << 62, ONE)])
    assert contents(cut) == Counter([(1, ONE), (2, left[2]), (3, ""), (4, ""), (5, left[5]), (5, left[5]), (6, gone[6]), (None, gone[1 << 62])])
    pieces = STAGES["packing"](spark, cut, folder).collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == Counter(r.doc_id for r in cut.collect())


def test_empty_table(spark, folder):
    docs = frame(spark, [(1, "x")]).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name
