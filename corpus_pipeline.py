"""A training-data pipeline over documents: five stages, each on all that the one before kept.

run(spark, sf_dir) applies them to the table documents, with each stage's result written as Parquet in the shared folder
and read again.  All stages but the last return the columns of documents.  A stage that drops rows drops them by doc_id
and text together, nulls included: a row's own verdict takes effect, whatever other rows have its doc_id.  Stages run one
after another in the same executors, so each begins with having them collect their garbage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenmill.llm.common import columns_of, documents, rested, settled, sized, whole_text
from screenmill.llm.exact_dedup import exact_rows
from screenmill.llm.minhash_dedup import near_rows
from screenmill.llm.packing import pack
from screenmill.llm.repeated_spans import remove_repeats
from screenmill.llm.toxicity import toxic_rows


def held(docs: DataFrame) -> DataFrame:
    """The rows as one column, with id and hash beside it: columns of documents may have any names."""
    return docs.select(F.struct(*columns_of(docs)).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(whole_text()).alias("hash"))


def matching(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """The rows of docs that are (left_semi) or are not (left_anti) among the rows (doc_id, text_hash)."""
    here, there = held(docs).alias("here"), rows.select("doc_id", "text_hash").alias("there")
    same = F.col("here.id").eqNullSafe(F.col("there.doc_id")) & (F.col("here.hash") == F.col("there.text_hash"))
    return here.join(there, same, how).select("row.*")


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of docs that are not in the list (doc_id, text_hash), which is counted first: short ones are broadcast."""
    return matching(docs, sized(rows.select("doc_id", "text_hash").distinct()), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 5 rejects go; it learns from the labels of the documents that it is given."""
    rested(spark)
    return without(docs, toxic_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("predicted = 1"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; of rows that repeat doc_id and text, one."""
    rested(spark)
    copies = settled(exact_rows(docs).filter("group_size > 1").groupBy("doc_id", "text_hash").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")), "pipeline-copies")
    doubles = sized(copies.filter("kept AND n > 1"))
    left = without(docs, copies.filter("NOT kept"))
    if doubles.isEmpty():
        return left
    once = held(matching(left, doubles, "left_semi")).dropDuplicates(["id", "hash"]).select("row.*")
    return matching(left, doubles, "left_anti").unionByName(once)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    rested(spark)
    return without(docs, near_rows(docs).filter("NOT kept"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller doc_id has are cut out; n_chars follows."""
    rested(spark)
    others = {c: f"c{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    names = [others.get(c, c) for c in docs.columns]
    cut = remove_repeats(docs.toDF(*names), carried=list(others.values()))
    if "n_chars" in others:
        cut = cut.withColumn(others["n_chars"], F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(names).toDF(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document, also an emptied one, is packed into sequences of 2048 tokens."""
    rested(spark)
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("packing", pack_sequences),
]

#: SQL can't express the learnt scores, the components nor the packing: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
