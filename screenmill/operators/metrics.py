"""Cost and latency of runs: roll-ups, latest rows, run details."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pricing_table(spark: SparkSession, rows: list[tuple[str, str, str, float, float]]) -> DataFrame:
    """The pricing dimension: model, provider, label, USD per million tokens in and out."""
    return spark.createDataFrame(rows, "model string, provider string, label string, input double, output double")


def with_cost(outputs: DataFrame, pricing: DataFrame) -> DataFrame:
    """label and cost_usd of each completion; a model without a price costs 0 and is its own label."""
    priced = outputs.join(pricing.select("model", "label", F.col("input").alias("_in"), F.col("output").alias("_out")), "model", "left")
    cost = (F.coalesce("input_tokens", F.lit(0)) * F.col("_in") + F.coalesce("output_tokens", F.lit(0)) * F.col("_out")) / 1e6
    return priced.withColumn("label", F.coalesce("label", "model")).withColumn("cost_usd", F.coalesce(cost, F.lit(0.0))).drop("_in", "_out")


def attributable(outputs: DataFrame) -> DataFrame:
    """Rows that belong to a run."""
    return outputs.filter("run_id IS NOT NULL")


def agent_metrics(outputs: DataFrame) -> DataFrame:
    """Per agent and model (null is a group of its own): averages and number of runs; null averages count as 0."""
    return attributable(outputs).groupBy("agent", "model").agg(F.coalesce(F.avg("cost_usd"), F.lit(0.0)).alias("avg_cost"), F.coalesce(F.avg("duration_ms"), F.lit(0.0)).alias("avg_duration_ms"), F.count(F.lit(1)).alias("run_count"))


def model_metrics(outputs: DataFrame) -> DataFrame:
    """Per named model: sums of tokens and cost, the dearest first."""
    named = attributable(outputs).filter("model IS NOT NULL AND model <> ''")
    return named.groupBy("model").agg(*(F.sum(c).alias(f"total_{c}") for c in ("input_tokens", "output_tokens", "cost_usd"))).orderBy(F.desc_nulls_last("total_cost_usd"), "model")


def run_totals(runs: DataFrame) -> DataFrame:
    """Totals and averages over all runs with a cost."""
    return runs.filter("total_cost_usd IS NOT NULL").agg(F.count(F.lit(1)).alias("total_runs"), F.sum("total_cost_usd").alias("total_cost"), F.avg("total_cost_usd").alias("avg_cost"), F.sum("total_duration_ms").alias("total_duration"), F.avg("total_duration_ms").alias("avg_duration"))


def agent_averages(metrics: DataFrame) -> DataFrame:
    """Per agent, the averages over its models weighted by their numbers of runs; 0 without runs."""
    mean = lambda c: F.coalesce(F.sum(F.col(c) * F.col("run_count")) / F.nullif(F.sum("run_count"), F.lit(0)), F.lit(0.0))
    return metrics.groupBy("agent").agg(mean("avg_cost").alias("avg_cost"), mean("avg_duration_ms").alias("avg_duration_ms"), F.sum("run_count").alias("run_count"))


def per_run(outputs: DataFrame) -> DataFrame:
    """Sums over the agents of a run, null as 0."""
    total = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    return outputs.groupBy("run_id").agg(total("duration_ms").alias("total_duration_ms"), total("cost_usd").alias("total_cost_usd"), total("input_tokens").alias("total_input_tokens"), total("output_tokens").alias("total_output_tokens"))


def union_agents(tables: dict[str, DataFrame]) -> DataFrame:
    """One table of all agents' outputs, tagged with the agent."""
    out = None
    for agent, table in tables.items():
        tagged = table.withColumn("agent", F.lit(agent))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the order of (column, descending); aggregated before the shuffle.

    Nulls come last in either direction; order must tell the rows of a key apart.
    """
    fields = []
    for name, descending in order:
        null_last = F.col(name).isNull() if not descending else F.col(name).isNotNull()
        fields += [null_last.alias(f"{name}_n"), F.col(name).alias(f"{name}_v")]
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if order[0][1] else F.min_by
    if len({d for _, d in order}) > 1:
        raise ValueError("all columns of the order must have one direction")
    return df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*fields)).alias("r")).select(*keys, "r.*").select(df.columns)


def latest_outputs(outputs: DataFrame) -> DataFrame:
    """Latest output of each project and agent: by run, then by time, then by id, nulls last."""
    return latest(outputs, ["project_id", "agent"], [("run_id", True), ("saved_at", True), ("id", True)])


def latest_runs(runs: DataFrame) -> DataFrame:
    return latest(runs, ["project_id"], [("saved_at", True), ("id", True)])


def runs_with_project(runs: DataFrame, projects: DataFrame, how: str = "inner") -> DataFrame:
    """Runs with their project's name, newest first."""
    return runs.join(projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name")), "project_id", how).orderBy(F.desc("saved_at"), F.desc("id"))


def run_detail(runs: DataFrame, projects: DataFrame, outputs: DataFrame) -> DataFrame:
    """Each run with the first output row (lowest id) of each of its agents; runs without outputs stay."""
    first = outputs.groupBy("run_id", "agent").agg(F.min_by(F.struct("model", "input_tokens", "output_tokens", "cost_usd", "duration_ms"), F.struct("id", "cost_usd", "input_tokens")).alias("o")).select("run_id", "agent", "o.*")
    named = runs.join(projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name")), "project_id", "left")
    return named.select(F.col("id").alias("run_id"), "project_id", "project_name", "total_cost_usd").join(first, "run_id", "left")


def build_runs(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs and outputs of saved payloads (run_id, project_id, started_at, agents: map of agent to struct).

    One output row for each agent whose payload isn't null; the run holds their sums.
    """
    rows = payloads.select("run_id", "project_id", F.explode("agents").alias("agent", "p")).filter("p IS NOT NULL")
    outputs = rows.select("run_id", "project_id", "agent", "p.*")
    runs = payloads.select("run_id", "project_id", F.try_to_timestamp("started_at").alias("started_at")).join(per_run(outputs), "run_id", "left").fillna(0, ["total_duration_ms", "total_cost_usd", "total_input_tokens", "total_output_tokens"])
    return runs, outputs
