"""Tables in buckets against dictionaries: upserts, replaced groups, deletions, compaction, and what is read."""

from __future__ import annotations

import random

import pytest

from screenmill.sources.buckets import BucketTable

KIND = "k int, j string, v int, id int"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_upserts_and_deletions(spark, tmp_path):
    rng = random.Random(1)
    fresh = lambda n, tag: [(k, j, rng.randrange(9), tag + x) for x, (k, j) in enumerate(rng.sample([(k, j) for k in [*range(12), None] for j in ("a", None)], n))]
    first = fresh(15, 100)
    table = BucketTable.create(spark.createDataFrame(first, KIND), str(tmp_path / "t"), ["k", "j"], buckets=5, keep=("id",))
    want = {(k, j): (v, i) for k, j, v, i in first}
    for step in range(4):
        more = fresh(9, 200 + 100 * step)
        table.write(spark.createDataFrame(more, KIND))
        for k, j, v, i in more:
            want[k, j] = v, want.get((k, j), (0, i))[1]
        gone = rng.sample(sorted(want, key=repr), 3)
        table.delete(spark.createDataFrame(gone, "k int, j string"))
        want = {key: x for key, x in want.items() if key not in gone}
        as_rows = sorted(((*key, *x) for key, x in want.items()), key=repr)
        assert rows_of(table.read()) == as_rows
        if step == 1:
            assert table.compact(2) and max(table.folders().values()) <= 2
            assert rows_of(table.read()) == as_rows
    assert rows_of(BucketTable(spark, str(tmp_path / "t")).read()) == as_rows
    table.compact()
    assert set(table.folders().values()) <= {1} and rows_of(table.read()) == as_rows
    assert table.compact() == []
    asked = spark.createDataFrame([as_rows[0][:2], as_rows[-1][:2], (77, "none")], "k int, j string")
    assert rows_of(table.find(asked)) == sorted([as_rows[0], as_rows[-1]], key=repr)


def test_groups_are_replaced_as_a_whole(spark, tmp_path):
    start = [(k % 6, "x", k, k) for k in range(30)] + [(None, "x", 1, 1)]
    table = BucketTable.create(spark.createDataFrame(start, KIND), str(tmp_path / "t"), ["k"], buckets=3, keyed=False)
    new = [(2, "new", 1, 1), (2, "new", 2, 2), (9, "new", 3, 3), (None, "new", 4, 4)]
    table.write(spark.createDataFrame(new, KIND))
    want = sorted([r for r in start if r[0] not in (2, None)] + new, key=repr)
    assert rows_of(table.read()) == want
    table.write(spark.createDataFrame(new, KIND))
    table.compact()
    assert rows_of(table.read()) == want
    table.delete(spark.createDataFrame([(9,)], "k int"))
    assert rows_of(table.read()) == [r for r in want if r[0] != 9]


def test_only_touched_buckets_are_read_and_rewritten(spark, tmp_path):
    table = BucketTable.create(spark.range(4000).selectExpr("cast(id as string) AS doc_id", "id AS v"), str(tmp_path / "t"), ["doc_id"], buckets=16, bloom="doc_id")
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t" / "data").glob("*/*/*.parquet")}
    one = spark.createDataFrame([("77", -1)], "doc_id string, v long")
    assert table.write(one) == 1
    touched = table.compact()
    assert len(touched) == 1
    files = {f.split("/_bucket=")[1].split("/")[0] for f in table.find(one).inputFiles()}
    assert files == {str(touched[0])}
    assert rows_of(table.find(one)) == [("77", -1)] and table.read().count() == 4000
    assert {p: p.stat().st_mtime_ns for p in before} == before
    in_use = {folder for _, folder, _ in table.manifest()[1]}
    assert len(in_use) == 2


def test_two_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1, 1)], KIND)
    table = BucketTable.create(rows, str(tmp_path / "t"), ["k"], buckets=2)
    newest, entries = table.manifest()
    table.write(rows)
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        table.commit(newest, entries)


def test_empty_table(spark, tmp_path):
    table = BucketTable.opened(spark.createDataFrame([(1, "a", 1, 1)], KIND), str(tmp_path / "t"), ["k"])
    assert table.read().count() == 0 and table.compact() == []
    assert BucketTable.opened(table.read(), str(tmp_path / "t"), ["k"]).find(table.read()).count() == 0
