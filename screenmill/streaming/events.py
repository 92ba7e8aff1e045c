"""Roll-ups of the feed of run events, as streams and as batches, and incremental intake of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenmill.operators.chunking import chunk_regulation
from screenmill.operators.merge import ingest_status
from screenmill.sources.buckets import BucketTable
from screenmill.sources.io import written
from screenmill.sources.xml_sections import parse_regulation_xml
from screenmill.vocab import MAX_TOKENS, MIN_TOKENS


def agent_totals(events: DataFrame, window: str, slide: str | None = None) -> DataFrame:
    """Per time window, agent and model: completions, duration, tokens and cost.  Batch, or stream with a watermark."""
    done, cost = F.col("event") == "agent_complete", F.col("event") == "agent_cost"
    sums = [F.count_if(done).alias("completions"), F.sum(F.when(done, F.col("duration_ms"))).alias("duration_ms"), *(F.sum(F.when(cost, F.col(c))).alias(c) for c in ("input_tokens", "output_tokens", "cost_usd"))]
    made = events.filter(done | cost).groupBy(F.window("ts", window, slide), "agent", "model").agg(*sums)
    return made.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "agent", "model", "completions", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("duration_ms", "input_tokens", "output_tokens", "cost_usd")))


def stream_agent_totals(events: DataFrame, watermark: str, window: str, slide: str | None = None) -> DataFrame:
    """The same as a stream: rows later than the watermark are dropped, state is bounded by it."""
    return agent_totals(events.withWatermark("ts", watermark), window, slide)


def run_sessions(events: DataFrame, gap: str) -> DataFrame:
    """Sessions of a run's events without a pause of the gap: begin, end, number of events and failures."""
    failed = F.col("event").isin("agent_error", "cancelled")
    made = events.groupBy(F.session_window("ts", gap), "run_id").agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("event") == "agent_complete").alias("completed"), F.count_if(failed).alias("failures"), F.bool_or(F.col("event") == "result").alias("finished"))
    return made.select("run_id", F.col("session_window.start").alias("started_at"), F.col("session_window.end").alias("ended_at"), "n_events", "completed", "failures", "finished")


def stream_runs(events: DataFrame, watermark: str, gap: str) -> DataFrame:
    return run_sessions(events.withWatermark("ts", watermark), gap)


def start_intake(files: DataFrame, sink: Callable[[DataFrame], None], checkpoint: str, watermark: str = "1 day", **trigger):
    """A stream of files (path, content, modificationTime): new contents, by SHA-256, go to the sink in micro-batches."""
    named = files.withColumn("sha256", F.sha2("content", 256)).withWatermark("modificationTime", watermark).dropDuplicatesWithinWatermark(["sha256"])
    return named.writeStream.foreachBatch(lambda batch, _: sink(batch)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


#: Buckets of the tables that files are taken into, and data folders of a bucket after which it is compacted.
BUCKETS, MOST_FOLDERS = 64, 8


def ingest(batch: DataFrame, folder: str, least: int = MIN_TOKENS, most: int = MAX_TOKENS, buckets: int = BUCKETS, most_folders: int = MOST_FOLDERS) -> None:
    """One micro-batch of regulation XML (path, content): contents that are new become sections and chunks.

    Below folder are tables in buckets: chunks (replaced by document), status (a row for each document, failed with a
    reason where there are no sections or chunks) and digests (the SHA-256 of every content that was taken in, and the
    path that it came with).  A content is new if its digest isn't stored, whenever it came first.  Digests are written
    last, so a batch that failed is done again as a whole, and doing it twice changes nothing.
    """
    spark = batch.sparkSession
    # the batch is read and digested once; what decides about files are narrow rows, and only new contents are shuffled
    files = written(batch.select(F.sha2("content", 256).alias("doc_id"), "path", "content", F.monotonically_increasing_id().alias("row")), "ingest-files").filter("doc_id IS NOT NULL")
    table = lambda like, name, **facts: BucketTable.opened(like, f"{folder}/{name}", ["doc_id"], buckets=buckets, **facts)
    digests = table(spark.createDataFrame([], "doc_id string, path string"), "digests", bloom="doc_id")
    once = files.groupBy("doc_id").agg(F.min_by(F.struct("path", "row"), F.struct(F.col("path").isNull(), "path")).alias("r")).select("doc_id", "r.*")
    docs = written(once.join(digests.find(files).select("doc_id"), "doc_id", "left_anti"), "ingest-new")
    if docs.isEmpty():
        return
    parsed = written(parse_regulation_xml(files.select("row", "doc_id", "content").join(docs.select("row").hint("shuffle_hash"), "row")), "ingest-sections")
    found = parsed.filter("error IS NULL AND section IS NOT NULL")
    sections = found.select("doc_id", "pos", F.lit("cfr_regulation").alias("document_type"), "section", "title", "body", "citation", F.array().cast("array<int>").alias("pages"), "part", "part_title", *(F.lit(None).cast("string").alias(c) for c in ("parent_statute", "statute_title", "effective_date")))
    chunks = chunk_regulation(sections, least, most)
    stored = table(chunks, "chunks", keyed=False)
    stored.write(chunks)
    status = ingest_status(docs.select("doc_id", "path"), sections.select("doc_id"), stored.find(docs).select("doc_id"))
    statuses = table(status, "status")
    statuses.write(status)
    digests.write(docs.select("doc_id", "path"))
    for t in (stored, statuses, digests):
        t.compact(most_folders)


def start_ingest(files: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None, **limits):
    """The whole chain on a stream of files (path, content): new contents are parsed, chunked and stored below folder."""
    writer = files.writeStream.foreachBatch(lambda batch, _: ingest(batch, folder, **limits))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
