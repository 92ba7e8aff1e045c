"""Queries on the cost and latency of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from screenmill.operators import metrics as M
from screenmill.plans.registry import OUTPUTS, Tables, query
from screenmill.streaming import events as E
from screenmill.streaming import runs as RS
from screenmill.vocab import AGENTS


def rounded(df, places: int = 2):
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query(f"""WITH {OUTPUTS} SELECT agent, model, round(avg(cost_usd), 2) AS avg_cost, round(avg(duration_ms), 2) AS avg_duration_ms, count(*) AS run_count
FROM outputs WHERE run_id IS NOT NULL GROUP BY agent, model""")
def run_metrics_by_agent(t: Tables):
    return rounded(M.agent_metrics(t.outputs()))


@query(f"""WITH {OUTPUTS} SELECT model, sum(input_tokens)::BIGINT AS total_input_tokens, sum(output_tokens)::BIGINT AS total_output_tokens, round(sum(cost_usd), 2) AS total_cost_usd
FROM outputs WHERE model <> '' GROUP BY model""")
def run_metrics_by_model(t: Tables):
    return rounded(M.model_metrics(t.outputs()))


@query("""SELECT count(*) AS total_runs, round(sum(o_totalprice), 2) AS total_cost, round(avg(o_totalprice), 2) AS avg_cost,
sum(o_orderkey % 1000)::BIGINT AS total_duration, round(avg(o_orderkey % 1000), 2) AS avg_duration FROM orders""")
def run_totals(t: Tables):
    return rounded(M.run_totals(t.runs()))


@query(f"""WITH {OUTPUTS}, m AS (SELECT agent, model, avg(cost_usd) AS c, avg(duration_ms) AS d, count(*) AS n FROM outputs GROUP BY agent, model)
SELECT agent, round(sum(c * n) / sum(n), 2) AS avg_cost, round(sum(d * n) / sum(n), 2) AS avg_duration_ms, sum(n)::BIGINT AS run_count FROM m GROUP BY agent""")
def agent_weighted_averages(t: Tables):
    return rounded(M.agent_averages(M.agent_metrics(t.outputs())))


@query(f"""WITH {OUTPUTS} SELECT run_id, sum(duration_ms)::BIGINT AS total_duration_ms, round(sum(cost_usd), 2) AS total_cost_usd,
sum(input_tokens)::BIGINT AS total_input_tokens, sum(output_tokens)::BIGINT AS total_output_tokens FROM outputs GROUP BY run_id""")
def totals_per_run(t: Tables):
    return rounded(M.per_run(t.outputs()))


@query(f"""WITH {OUTPUTS}, o AS (SELECT o_custkey AS project_id, outputs.* FROM outputs JOIN orders ON run_id = o_orderkey),
r AS (SELECT *, row_number() OVER (PARTITION BY project_id, agent ORDER BY run_id DESC NULLS LAST, saved_at DESC NULLS LAST, id DESC) AS k FROM o)
SELECT project_id, agent, run_id, saved_at, id FROM r WHERE k = 1""")
def latest_outputs(t: Tables):
    runs = t.runs().select(F.col("id").alias("run_id"), "project_id")
    return M.latest_outputs(t.outputs().join(runs, "run_id").select("project_id", "agent", "run_id", "saved_at", "id"))


@query("""WITH r AS (SELECT o_custkey AS project_id, o_orderkey AS id, o_orderdate AS saved_at, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders)
SELECT project_id, id, saved_at FROM r WHERE k = 1""")
def latest_runs(t: Tables):
    return M.latest_runs(t.runs().select("project_id", "id", "saved_at"))


@query("""SELECT o_custkey AS project_id, o_orderkey AS id, round(o_totalprice, 2) AS total_cost_usd, o_orderkey % 1000 AS total_duration_ms, o_orderdate AS saved_at,
CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS project_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def runs_with_project(t: Tables):
    return rounded(M.runs_with_project(t.runs(), t.projects().filter("id % 7 <> 0"), "left"))


@query("""SELECT o_custkey AS project_id, o_orderkey AS id, round(o_totalprice, 2) AS total_cost_usd, o_orderkey % 1000 AS total_duration_ms, o_orderdate AS saved_at, c_name AS project_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 7 <> 0""")
def runs_of_known_projects(t: Tables):
    return rounded(M.runs_with_project(t.runs(), t.projects().filter("id % 7 <> 0"), "inner"))


@query(f"""WITH {OUTPUTS}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, agent ORDER BY id, cost_usd, input_tokens) AS k FROM outputs) WHERE k = 1)
SELECT o_orderkey AS run_id, o_custkey AS project_id, c_name AS project_name, round(o_totalprice, 2) AS total_cost_usd, agent, model, input_tokens, output_tokens, round(cost_usd, 2) AS cost_usd, duration_ms FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN f ON run_id = o_orderkey""")
def run_detail(t: Tables):
    return rounded(M.run_detail(t.runs(), t.projects(), t.outputs()))


@query("""WITH price AS (SELECT p_brand AS model, 'Label ' || p_brand AS label, min(p_retailprice) AS i, max(p_retailprice) AS o FROM part WHERE p_brand < 'Brand#4' GROUP BY p_brand),
c AS (SELECT p_brand AS model, l_quantity::BIGINT AS a, (l_quantity * 2)::BIGINT AS b FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT coalesce(label, c.model) AS label, count(*) AS n, round(sum(coalesce((a * i + b * o) / 1e6, 0)), 4) AS cost_usd FROM c LEFT JOIN price USING (model) GROUP BY 1""")
def completion_cost(t: Tables):
    part = t.part
    price = part.filter("p_brand < 'Brand#4'").groupBy(F.col("p_brand").alias("model")).agg(F.concat(F.lit("Label "), F.first("p_brand")).alias("label"), F.min("p_retailprice").alias("input"), F.max("p_retailprice").alias("output"))
    used = t.lineitem.join(part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("model")), "l_partkey").select("model", F.col("l_quantity").cast("long").alias("input_tokens"), (F.col("l_quantity") * 2).cast("long").alias("output_tokens"))
    return rounded(M.with_cost(used, price).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("cost_usd").alias("cost_usd")), 4)


@query(f"WITH {OUTPUTS} SELECT agent, count(*) AS n, sum(input_tokens)::BIGINT AS tokens FROM outputs GROUP BY agent")
def union_of_agent_tables(t: Tables):
    own = t.outputs()
    tables = {f"agent_{k}": own.filter(F.col("agent") == f"agent_{k}").drop("agent") for k in range(1, 6)}
    return M.union_agents(tables).groupBy("agent").agg(F.count(F.lit(1)).alias("n"), F.sum("input_tokens").alias("tokens"))


def run_events(t: Tables):
    """The events table as a feed: odd ids complete an agent's work, even ones report its cost."""
    odd = F.col("event_id") % 2 == 1
    return t.events.select("ts", F.col("user_id").alias("run_id"), F.when(odd, "agent_complete").otherwise("agent_cost").alias("event"), F.col("event_type").alias("agent"), (F.col("event_id") % 100).alias("duration_ms"), F.lit("m").alias("model"), (F.col("event_id") % 50).alias("input_tokens"), (F.col("event_id") % 20).alias("output_tokens"), F.col("value").alias("cost_usd"))


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, event_type AS agent, 'm' AS model,
count(*) FILTER (event_id % 2 = 1) AS completions, coalesce(sum(event_id % 100) FILTER (event_id % 2 = 1), 0)::BIGINT AS duration_ms, coalesce(sum(event_id % 50) FILTER (event_id % 2 = 0), 0)::BIGINT AS input_tokens,
coalesce(sum(event_id % 20) FILTER (event_id % 2 = 0), 0)::BIGINT AS output_tokens, round(coalesce(sum(value) FILTER (event_id % 2 = 0), 0), 2) AS cost_usd FROM events GROUP BY 1, 2, 3""")
def event_totals(t: Tables):
    return rounded(E.agent_totals(run_events(t), "1 hour"))


@query("""WITH g AS (SELECT user_id AS run_id, ts, event_id, CASE WHEN ts < lag(ts) OVER w + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS k FROM g)
SELECT run_id, min(ts) AS started_at, max(ts) + INTERVAL '30 minutes' AS ended_at, count(*) AS n_events, count(*) FILTER (event_id % 2 = 1) AS completed, 0::BIGINT AS failures, false AS finished FROM s GROUP BY run_id, k""")
def event_sessions(t: Tables):
    return E.run_sessions(run_events(t), "30 minutes")


def staged_events(t: Tables):
    """The events table as a feed of stages: agents in turn, starts, ends, errors and costs by id; some runs end or are cancelled."""
    k = F.col("event_id")
    kind = F.when(k % 90 == 0, "result").when(k % 91 == 0, "cancelled").when(k % 97 == 0, "pipeline_error")
    for at, name in enumerate(("agent_start", "agent_complete", "agent_start", "agent_complete", "agent_error", "agent_cost")):
        kind = kind.when(k % 6 == at, name)
    return t.events.select("ts", F.col("user_id").alias("run_id"), kind.alias("event"), F.element_at(F.array(*map(F.lit, AGENTS)), (k / 2 % 5).cast("int") + 1).alias("agent"))


STAGES_SQL = f"""WITH e AS (SELECT ts, user_id AS run_id, event_id, CASE WHEN event_id % 90 = 0 THEN 'result' WHEN event_id % 91 = 0 THEN 'cancelled' WHEN event_id % 97 = 0 THEN 'pipeline_error'
 WHEN event_id % 6 IN (0, 2) THEN 'agent_start' WHEN event_id % 6 IN (1, 3) THEN 'agent_complete' WHEN event_id % 6 = 4 THEN 'agent_error' ELSE 'agent_cost' END AS event, {list(AGENTS)}[event_id // 2 % 5 + 1] AS agent FROM events),
g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL '6 hours' THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS k FROM g),
f AS (SELECT run_id, k, min(ts) AS started_at, max(ts) + INTERVAL '6 hours' AS ended_at, count(*) AS n_events, coalesce(arg_max(CASE event WHEN 'result' THEN 'finished' WHEN 'pipeline_error' THEN 'failed' ELSE 'cancelled' END, (ts, list_position(['result', 'pipeline_error', 'cancelled'], event)))
  FILTER (event IN ('result', 'pipeline_error', 'cancelled')), 'interrupted') AS run_status, max((ts, agent)) FILTER (event = 'cancelled') AS stopped FROM s GROUP BY 1, 2),
a AS (SELECT run_id, k, agent, arg_max(event, (ts, list_position(['agent_start', 'agent_complete', 'agent_error'], event))) AS last, count(*) FILTER (event = 'agent_start') AS starts, count(*) FILTER (event = 'agent_error') AS failures, max(ts) AS last_at
  FROM s WHERE event IN ('agent_start', 'agent_complete', 'agent_error') GROUP BY 1, 2, 3)"""


@query(f"""{STAGES_SQL} SELECT f.run_id, started_at, ended_at, n_events, run_status, CASE WHEN run_status = 'cancelled' THEN stopped[2] END AS stopped_before, p.agent,
CASE last WHEN 'agent_start' THEN 'running' WHEN 'agent_complete' THEN 'complete' WHEN 'agent_error' THEN 'error' ELSE 'pending' END AS status, coalesce(starts, 0) AS starts, coalesce(failures, 0) AS failures, last_at
FROM f CROSS JOIN (SELECT unnest({list(AGENTS)}) AS agent) p LEFT JOIN a ON a.run_id = f.run_id AND a.k = f.k AND a.agent = p.agent""")
def run_stages(t: Tables):
    made = RS.run_stages(staged_events(t), "6 hours")
    return made.select(*made.columns[:-1], F.explode("stages").alias("s")).select(*made.columns[:-1], "s.*")


@query(f"""{STAGES_SQL}, b AS (SELECT f.run_id, f.k, any_value(run_status) AS run_status, count(*) FILTER (last = 'agent_complete') AS done, count(*) FILTER (last = 'agent_error') AS failed FROM f LEFT JOIN a ON a.run_id = f.run_id AND a.k = f.k GROUP BY 1, 2)
SELECT run_status, done::INT AS stages_done, failed::INT AS stages_failed, done = 5 AND run_status = 'finished' AS complete, count(*) AS n FROM b GROUP BY 1, 2, 3, 4""")
def run_outcomes(t: Tables):
    made = RS.with_outcome(RS.run_stages(staged_events(t), "6 hours"))
    return made.groupBy("run_status", F.size("completed_stages").alias("stages_done"), F.size("failed_stages").alias("stages_failed"), "complete").agg(F.count(F.lit(1)).alias("n"))
