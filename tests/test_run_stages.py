"""Stages of runs: the batch against a plain loop, and the stream against the batch."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from screenmill.streaming import runs as R

STAGES = ("parse", "screen", "report")
EVENTS = [*R.STAGE_STATUS, *R.RUN_STATUS, "agent_cost", "pipeline_start", None]
BEGIN = datetime(2026, 1, 1)


def feed(seed, n):
    rng = random.Random(seed)
    weights = [8, 8, 4, 1, 1, 1, 6, 1, 1]
    rows = [(BEGIN + timedelta(seconds=rng.randrange(4000), milliseconds=rng.choice([0, 500])), rng.choice([1, 2, 3, None]), rng.choices(EVENTS, weights)[0], rng.choice([*STAGES, None])) for _ in range(n)]
    return rows + [(BEGIN, 9, "agent_start", "parse"), (BEGIN, 9, "agent_error", "parse"), (BEGIN, 9, "agent_complete", "parse"), (BEGIN + timedelta(seconds=60), 9, "result", None)]


def plain(rows, gap):
    out = []
    for run in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == run), key=lambda r: r[0])
        sessions = [[own[0]]]
        for r in own[1:]:
            if r[0] - sessions[-1][-1][0] < timedelta(seconds=gap):
                sessions[-1].append(r)
            else:
                sessions.append([r])
        for s in sessions:
            final = max(((t, list(R.RUN_STATUS).index(e)) for t, _, e, _ in s if e in R.RUN_STATUS), default=None)
            status = list(R.RUN_STATUS.values())[final[1]] if final else "interrupted"
            stopped = max(((t, a is not None, a or "") for t, _, e, a in s if e == "cancelled"), default=None)
            stages = []
            for name in STAGES:
                mine = [(t, list(R.STAGE_STATUS).index(e)) for t, _, e, a in s if a == name and e in R.STAGE_STATUS]
                last = max(mine, default=None)
                stages.append((name, list(R.STAGE_STATUS.values())[last[1]] if last else "pending", sum(c == 0 for _, c in mine), sum(c == 2 for _, c in mine), last and last[0]))
            out.append((run, s[0][0], s[-1][0] + timedelta(seconds=gap), len(s), status, stopped[2] if status == "cancelled" and stopped[1] else None, tuple(stages)))
    return sorted(out, key=repr)


def table(spark, rows):
    texts = [(t.isoformat(), *rest) for t, *rest in rows]
    return spark.createDataFrame(texts, "ts string, run_id long, event string, agent string").withColumn("ts", F.to_timestamp("ts"))


def as_utc(df):
    """Collected times are those of this machine's zone; shown as texts they are not."""
    text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return df.withColumns({"started_at": text("started_at"), "ended_at": text("ended_at"), "stages": F.transform("stages", lambda s: s.withField("last_at", text(s["last_at"])))})


def texts_of(df):
    return sorted(((r.run_id, r.started_at, r.ended_at, r.n_events, r.run_status, r.stopped_before, tuple(map(tuple, r.stages))) for r in as_utc(df).collect()), key=repr)


def plain_texts(rows, gap):
    text = lambda t: t and t.strftime("%Y-%m-%dT%H:%M:%S.%f")
    return sorted(((a, text(b), text(c), d, e, f, tuple((*s[:4], text(s[4])) for s in g)) for a, b, c, d, e, f, g in plain(rows, gap)), key=repr)


def test_batch_equals_loop(spark):
    rows = feed(1, 300)
    got = R.run_stages(table(spark, [*rows]), "90 seconds", STAGES)
    assert texts_of(got) == plain_texts(rows, 90)
    last = R.with_outcome(got).filter("run_id = 9").first()
    assert (last.failed_stages, last.completed_stages, last.complete, last.run_status) == (["parse"], [], False, "finished")
    assert R.run_stages(table(spark, rows).limit(0), "90 seconds", STAGES).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = sorted(feed(2, 300), key=lambda r: r[0])
    rng = random.Random(3)
    batches = [rows[k : k + 60] for k in range(0, len(rows), 60)]
    for k, batch in enumerate(batches):
        rng.shuffle(batch)
        table(spark, batch).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{k}"))
    # a last event far later lets the watermark pass all others
    table(spark, [(BEGIN + timedelta(days=2), 77, "agent_cost", None)]).coalesce(1).write.parquet(str(tmp_path / "in/x"))
    files = spark.readStream.schema("ts timestamp, run_id long, event string, agent string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    query = R.stream_run_stages(files, "5000 seconds", 90, STAGES).writeStream.format("memory").queryName("stages").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert texts_of(spark.table("stages")) == plain_texts(rows, 90)
