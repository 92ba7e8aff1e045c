"""Upserts, deletes and status changes as DataFrame rewrites: the caller writes the result to a new path or partition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with one key the first in the order; one exchange with the rows combined before it."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*").select(df.columns)


def insert_or_get(target: DataFrame, updates: DataFrame, key: str, order: list[str], moves: list[str] = ()) -> DataFrame:
    """Existing rows win over updates of the same key, except for the columns in moves, which take the update's value."""
    both = target.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    first = F.struct("_new", *order)
    rest = [c for c in target.columns if c != key]
    picked = both.groupBy(key).agg(F.min_by(F.struct(*rest), first).alias("r"), *(F.max_by(F.when(F.col("_new") == 1, F.col(c)), F.struct(F.when(F.col("_new") == 1, F.col(c)).isNotNull(), *order)).alias(f"_{c}") for c in moves))
    return picked.select(*(F.col(key) if c == key else F.coalesce(F.col(f"_{c}"), F.col(f"r.{c}")).alias(c) if c in moves else F.col(f"r.{c}").alias(c) for c in target.columns))


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], keep: list[str] = (), order: str | None = None) -> DataFrame:
    """Rows of the target with those of updates in place of equal keys; null keys equal each other.

    keep: columns (ids) that an existing row retains; order: of several updates of a key the one with the largest wins.
    """
    if order:
        rest = [c for c in updates.columns if c not in keys]
        updates = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, "r.*").select(updates.columns)
    t, u = target.alias("t"), updates.alias("u")
    joined = t.join(u, reduce(lambda a, b: a & b, (F.col(f"t.{k}").eqNullSafe(F.col(f"u.{k}")) for k in keys)), "full_outer").withColumn("_hit", F.coalesce(*(F.col(f"u.{c}").isNotNull() for c in updates.columns[:1]), F.lit(False)))
    updated = reduce(lambda a, b: a | b, (F.col(f"u.{c}").isNotNull() for c in updates.columns))
    return joined.select(*(F.when(updated, F.coalesce(F.col(f"t.{c}"), F.col(f"u.{c}")) if c in keep else F.col(f"u.{c}")).otherwise(F.col(f"t.{c}")).alias(c) if c in updates.columns else F.col(f"t.{c}").alias(c) for c in target.columns))


#: What identifies a source of regulation XML, and the fields that begin anew when it is loaded again.
SOURCE_KEY = ["source_type", "cfr_title", "cfr_part", "effective_date"]
SOURCE_RESET = {"status": "pending", "status_message": None, "chunks_total": None, "chunks_embedded": 0, "chunk_count": 0, "sections_count": 0, "parser_warnings": 0, "embedding_dim": None, "embedding_started_at": None, "embedding_finished_at": None}


def upsert_sources(target: DataFrame, updates: DataFrame) -> DataFrame:
    """Sources loaded again take the place of those of the same identity (nulls equal), keep their id and begin anew."""
    fresh = updates.select(*updates.columns, *(F.lit(v).cast(target.schema[c].dataType).alias(c) for c, v in SOURCE_RESET.items() if c in target.columns and c not in updates.columns))
    return upsert(target, fresh.select(target.columns), SOURCE_KEY, keep=["id"])


def upsert_ground_truth(target: DataFrame, updates: DataFrame) -> DataFrame:
    """One row of categories for each evaluation."""
    return upsert(target, updates, ["evaluation_id"])


def upsert_scores(target: DataFrame, updates: DataFrame) -> DataFrame:
    """One row of scores for each project."""
    return upsert(target, updates, ["project_id"])


def replace_partitions(target: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """All rows of the updates' partitions replaced; as a sink: partitionBy(key) with dynamic partition overwrite."""
    return target.join(updates.select(key).distinct(), key, "left_anti").select(target.columns).unionByName(updates)


def cascade_delete(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    return children.join(deleted.select(key).distinct(), key, "left_anti").select(children.columns)


def set_null(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    gone = deleted.select(key).distinct().withColumn("_gone", F.lit(True))
    return children.join(gone, key, "left").withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).select(children.columns)


def transition(df: DataFrame, ids: DataFrame, allowed: list[str], to: str, reset: dict[str, object] = {}) -> DataFrame:
    """Rows of the ids whose status is allowed go to another; transitioned tells which."""
    asked = df.join(ids.select("id").distinct().withColumn("_asked", F.lit(True)), "id", "left")
    moved = F.col("_asked").isNotNull() & F.col("status").isin(*allowed)
    out = asked.withColumn("transitioned", F.coalesce(moved, F.lit(False)))
    for name, value in {"status": to, **reset}.items():
        out = out.withColumn(name, F.when(F.col("transitioned"), F.lit(value)).otherwise(F.col(name)))
    return out.select(*df.columns, "transitioned")


def sweep_stuck(df: DataFrame, message: str = "interrupted", stuck: tuple[str, ...] = ("pending", "embedding")) -> DataFrame:
    hit = F.col("status").isin(*stuck)
    return df.withColumn("status_message", F.when(hit, message).otherwise(F.col("status_message"))).withColumn("status", F.when(hit, "failed").otherwise(F.col("status")))


def apply_status(df: DataFrame, updates: DataFrame) -> DataFrame:
    """Only the supplied (non-null) fields change; a good state clears the message."""
    names = [c for c in updates.columns if c != "id"]
    joined = df.join(updates.select("id", *(F.col(c).alias(f"_{c}") for c in names)), "id", "left")
    for c in names:
        joined = joined.withColumn(c, F.coalesce(f"_{c}", c))
    clears = F.col("_status").isin("pending", "embedding", "ready") if "status" in names else F.lit(False)
    return joined.withColumn("status_message", F.when(clears, None).otherwise(F.col("status_message"))).select(df.columns)


def ingest_status(docs: DataFrame, sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """Numbers of sections and chunks of each document, and failed with a reason where there are none."""
    count = lambda df, name: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    out = docs.join(count(sections, "sections_count"), "doc_id", "left").join(count(chunks, "chunks_count"), "doc_id", "left").fillna(0, ["sections_count", "chunks_count"])
    reason = F.when(F.col("sections_count") == 0, "no sections found").when(F.col("chunks_count") == 0, "no chunks produced")
    return out.withColumn("status", F.when(reason.isNotNull(), "failed").otherwise("ready")).withColumn("status_message", reason)


def assign(df: DataFrame, ids: DataFrame, project_id) -> DataFrame:
    """The sources of the ids get the project (None: lose theirs); matched tells which there were."""
    hit = df.join(ids.select("id").distinct().withColumn("matched", F.lit(True)), "id", "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
    return hit.withColumn("project_id", F.when(F.col("matched"), F.lit(project_id)).otherwise(F.col("project_id"))).select(*df.columns, "matched")


def backfill_source_id(chunks: DataFrame) -> DataFrame:
    """source_id from metadata where it has a UUID's shape and none is set."""
    shaped = F.when(F.col("metadata_source").rlike(r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.col("metadata_source"))
    return chunks.withColumn("source_id", F.coalesce("source_id", shaped))


def backfill_current(df: DataFrame) -> DataFrame:
    """Rows from before the default changed: is_current is true for all."""
    return df.withColumn("is_current", F.lit(True))


def reset_on_dimension_change(evaluations: DataFrame, chunks: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """The two tables when the provider's vectors have dim numbers: if stored ones have another length, every evaluation is failed and no chunk stays."""
    other = chunks.filter(F.size("embedding") != dim).agg(F.min(F.size("embedding")).alias("_old"))
    joined = evaluations.join(F.broadcast(other))  # one row
    hit = F.col("_old").isNotNull() & (F.col("status") != "failed")
    message = F.format_string(f"embedding dim changed from %d to {dim}; reingest required", F.col("_old"))
    failed = joined.withColumn("status_message", F.when(hit, message).otherwise(F.col("status_message"))).withColumn("status", F.when(hit, "failed").otherwise(F.col("status")))
    return failed.select(evaluations.columns), chunks.join(F.broadcast(other)).filter("_old IS NULL").select(chunks.columns)


def check_dimension(chunks: DataFrame, dim: int) -> DataFrame:
    """dimension_ok per chunk: whether its vector has the provider's length."""
    return chunks.withColumn("dimension_ok", F.coalesce(F.size("embedding") == dim, F.lit(False)))


def audit_outcomes(log: DataFrame) -> DataFrame:
    """Per correlation id its last status with duration, chunks and error, newest first."""
    last = F.max_by(F.struct("status", "error_message"), F.struct("ts", "status")).alias("l")
    return log.groupBy("correlation_id").agg(last, F.max("ts").alias("ts"), F.max("duration_ms").alias("duration_ms"), F.max("chunks_count").alias("chunks_count")).select("correlation_id", "ts", "l.status", "duration_ms", "chunks_count", "l.error_message").orderBy(F.desc("ts"), "correlation_id")


def audit_pair(runs: DataFrame) -> DataFrame:
    """The started row and the terminal row of each ingest (correlation_id, started_at, finished_at, ok, ...)."""
    started = runs.select("correlation_id", F.col("started_at").alias("ts"), F.lit("started").alias("status"), F.lit(None).cast("long").alias("duration_ms"), F.lit(None).cast("long").alias("chunks_count"), F.lit(None).cast("string").alias("error_message"))
    ended = runs.select("correlation_id", F.col("finished_at").alias("ts"), F.when(F.col("ok"), "ready").otherwise("failed").alias("status"), "duration_ms", "chunks_count", "error_message")
    return started.unionByName(ended)
