"""Registered queries: name -> function of (spark, sf_dir), with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function under its name; it gets a reader of the given tables instead of (spark, sf_dir)."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


class Tables:
    """The given tables, and the library's tables bound to them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def projects(self) -> DataFrame:
        return self.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))

    def runs(self) -> DataFrame:
        return self.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project_id"), F.col("o_totalprice").alias("total_cost_usd"), (F.col("o_orderkey") % 1000).alias("total_duration_ms"), F.col("o_orderdate").alias("saved_at"))

    def outputs(self) -> DataFrame:
        """The lines of an order are the outputs of five agents in turn; the model is missing for one return flag."""
        return self.lineitem.select(
            (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("id"), F.col("l_orderkey").alias("run_id"), F.concat(F.lit("agent_"), ((F.col("l_linenumber") - 1) % 5 + 1).cast("string")).alias("agent"),
            F.when(F.col("l_returnflag") != "N", F.concat("l_returnflag", "l_linestatus")).alias("model"), F.col("l_quantity").cast("long").alias("input_tokens"), (F.col("l_quantity") * 2).cast("long").alias("output_tokens"),
            F.col("l_extendedprice").alias("cost_usd"), (F.col("l_quantity") * 10).cast("long").alias("duration_ms"), F.col("l_shipdate").alias("saved_at"),
        )


OUTPUTS = """outputs AS (SELECT l_partkey * 100000 + l_suppkey AS id, l_orderkey AS run_id, 'agent_' || ((l_linenumber - 1) % 5 + 1) AS agent,
  CASE WHEN l_returnflag <> 'N' THEN l_returnflag || l_linestatus END AS model, l_quantity::BIGINT AS input_tokens, (l_quantity * 2)::BIGINT AS output_tokens,
  l_extendedprice AS cost_usd, (l_quantity * 10)::BIGINT AS duration_ms, l_shipdate AS saved_at FROM lineitem)"""
