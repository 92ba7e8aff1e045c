"""Readers and writers of tables, and validated intake of files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenmill.vocab import UPLOAD_LIMIT


def work_folder(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        top = tempfile.mkdtemp(prefix="spark-")  # driver and executors are one process
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows written to a table in the shared folder and read again, so that a lost executor costs one step only."""
    path = work_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, task_rows: int) -> DataFrame:
    """Narrow rows dealt to tasks of about so many, before each of them becomes large: a small file is one task otherwise."""
    return df.repartition(max(1, -(-df.count() // task_rows)))


def read_table(spark: SparkSession, path: str, schema: str | None = None, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] = (), mode: str = "errorifexists") -> None:
    """Parquet; with mode "overwrite" and partitions only the partitions in df are replaced."""
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content and content_type (by the name's ending) of files."""
    kind = F.when(F.lower("path").endswith(".pdf"), "application/pdf").when(F.lower("path").endswith(".xml"), "application/xml").otherwise("application/octet-stream")
    return spark.read.format("binaryFile").load(path).select("path", "content", kind.alias("content_type"))


def intake_files(files: DataFrame, max_bytes: int = UPLOAD_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Accepted files (filename, sha256, size_bytes) and rejected ones with the reason; the content isn't carried on."""
    size = F.coalesce(F.length("content"), F.lit(0))
    reason = (
        F.when(~F.coalesce(F.lower("content_type").contains("pdf"), F.lit(False)), "not a PDF")
        .when(size == 0, "empty file")
        .when(size > max_bytes, f"larger than {max_bytes} bytes")
        .when(F.substring("content", 1, 4) != F.lit(b"%PDF"), "no PDF header")
    )
    judged = files.withColumn("reject_reason", reason)
    accepted = judged.filter("reject_reason IS NULL").select("path", F.regexp_replace("path", "^.*/", "").alias("filename"), F.sha2("content", 256).alias("sha256"), size.cast("long").alias("size_bytes"))
    return accepted, judged.filter("reject_reason IS NOT NULL").select("path", "reject_reason")
