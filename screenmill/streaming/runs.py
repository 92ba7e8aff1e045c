"""What became of each stage of a run: which ran, failed or never began, and where the run was cancelled.

A run's events without a pause of the gap are a session.  In a batch sessions are Spark's session windows and stages are
aggregates with filters.  As a stream a processor keeps one small summary for each open session of a run, whatever its
number of events, merges summaries that an event joins, and a timer returns a session once the watermark is a gap past its
last event.  Both give the same rows, if no event is later than the watermark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from screenmill.vocab import AGENTS

#: Events that set the status of their stage or of the run; of events at one time the later in this order counts.
STAGE_STATUS = {"agent_start": "running", "agent_complete": "complete", "agent_error": "error"}
RUN_STATUS = {"result": "finished", "pipeline_error": "failed", "cancelled": "cancelled"}
STAGE = "struct<agent:string,status:string,starts:long,failures:long,last_at:timestamp>"
SESSION = "run_id long, started_at timestamp, ended_at timestamp, n_events long, run_status string, stopped_before string, stages array<struct<agent:string,status:string,starts:long,failures:long,last_at:timestamp>>"


def coded(event: Column, names: dict[str, str]) -> Column:
    """The place of the event among the names, null for others."""
    return F.coalesce(*(F.when(event == name, F.lit(k)) for k, name in enumerate(names)))


def named(code: Column, names: dict[str, str], other: str) -> Column:
    return F.coalesce(*(F.when(code == k, F.lit(status)) for k, status in enumerate(names.values())), F.lit(other))


def run_stages(events: DataFrame, gap: str, stages: tuple[str, ...] = AGENTS) -> DataFrame:
    """SESSION of every session of events (ts, run_id, event, agent): batch.

    A stage without an event of its own is pending, a run without a final event interrupted.  stopped_before: the stage
    that a cancelled run would have begun next.  Null run_ids are a run; events without a time are left out.
    """
    event, agent = F.col("event"), F.col("agent")
    order = lambda names: F.when(coded(event, names).isNotNull(), F.struct("ts", coded(event, names).alias("code")))
    own = lambda stage, value: F.when(agent == stage, value)
    per_stage = [
        F.struct(F.max(own(s, order(STAGE_STATUS))).alias("last"), F.count_if((agent == s) & (event == "agent_start")).alias("starts"), F.count_if((agent == s) & (event == "agent_error")).alias("failures")).alias(f"stage_{k}")
        for k, s in enumerate(stages)
    ]
    final = F.max(order(RUN_STATUS)).alias("final")
    stopped = F.max(F.when(event == "cancelled", F.struct("ts", "agent"))).alias("stopped")
    made = events.filter("ts IS NOT NULL").groupBy(F.session_window("ts", gap), "run_id").agg(F.count(F.lit(1)).alias("n_events"), final, stopped, *per_stage)
    status = named(F.col("final.code"), RUN_STATUS, "interrupted")
    rows = [F.struct(F.lit(s).alias("agent"), named(F.col(f"stage_{k}.last.code"), STAGE_STATUS, "pending").alias("status"), F.col(f"stage_{k}.starts").alias("starts"), F.col(f"stage_{k}.failures").alias("failures"), F.col(f"stage_{k}.last.ts").alias("last_at")) for k, s in enumerate(stages)]
    return made.select("run_id", F.col("session_window.start").alias("started_at"), F.col("session_window.end").alias("ended_at"), "n_events", status.alias("run_status"), F.when(status == "cancelled", F.col("stopped.agent")).alias("stopped_before"), F.array(*rows).alias("stages"))


def with_outcome(sessions: DataFrame) -> DataFrame:
    """completed and failed_stages (names), and complete: whether every stage ended well and the run finished."""
    of = lambda status: F.transform(F.filter("stages", lambda s: s["status"] == status), lambda s: s["agent"])
    done = F.size(of("complete")) == F.size("stages")
    return sessions.withColumns({"completed_stages": of("complete"), "failed_stages": of("error"), "complete": done & (F.col("run_status") == "finished")})


class Summary:
    """A session of one run: places are (time, code) pairs, so that any two summaries merge."""

    def __init__(self, first: int, last: int, n: int = 0, final=None, stopped=None, stages=None):
        self.first, self.last, self.n, self.final, self.stopped, self.stages = first, last, n, final, stopped, stages or {}

    @classmethod
    def of(cls, at: int, event: str | None, agent: str | None) -> Summary:
        out = cls(at, at, 1)
        if event in RUN_STATUS:
            out.final = [at, list(RUN_STATUS).index(event)]
        if event == "cancelled":
            out.stopped = [at, agent is not None, agent or ""]
        if agent is not None and (event in STAGE_STATUS):
            out.stages[agent] = [[at, list(STAGE_STATUS).index(event)], int(event == "agent_start"), int(event == "agent_error")]
        return out

    def merge(self, other: Summary) -> Summary:
        larger = lambda a, b: max((x for x in (a, b) if x is not None), default=None)
        stages = dict(self.stages)
        for agent, (last, starts, failures) in other.stages.items():
            own = stages.get(agent, [last, 0, 0])
            stages[agent] = [max(own[0], last), own[1] + starts, own[2] + failures]
        return Summary(min(self.first, other.first), max(self.last, other.last), self.n + other.n, larger(self.final, other.final), larger(self.stopped, other.stopped), stages)


class Sessions(StatefulProcessor):
    """The open sessions of each run, as one value; a timer at the end of the first that will close."""

    def __init__(self, gap_us: int, stages: tuple[str, ...]):
        self.gap, self.names = gap_us, stages

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getValueState("open", "summaries string")

    def load(self) -> list[Summary]:
        held = self.open.get()
        return [Summary(**x) for x in json.loads(held[0])] if held else []

    def store(self, summaries: list[Summary]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if summaries:
            self.open.update((json.dumps([vars(s) for s in summaries]),))
            # timers count milliseconds: not before the end
            self.handle.registerTimer(-(-(min(s.last for s in summaries) + self.gap) // 1000))
        else:
            self.open.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        made: list[Summary] = []
        for s in sorted(self.load() + [Summary.of(r.us, r.event, r.agent) for r in rows], key=lambda s: s.first):
            if made and s.first - made[-1].last < self.gap:
                made[-1] = made[-1].merge(s)
            else:
                made.append(s)
        self.store(made)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = self.load()
        self.store([s for s in held if s.last + self.gap > now])
        for s in held:
            if s.last + self.gap <= now:
                yield Row(run_id=key[0], us=json.dumps(self.row(s)))

    def row(self, s: Summary) -> dict:
        status = list(RUN_STATUS.values())[s.final[1]] if s.final else "interrupted"
        stages = []
        for name in self.names:
            last, starts, failures = s.stages.get(name, (None, 0, 0))
            stages.append({"agent": name, "status": list(STAGE_STATUS.values())[last[1]] if last else "pending", "starts": starts, "failures": failures, "last_at": last[0] if last else None})
        stopped = s.stopped[2] if status == "cancelled" and s.stopped[1] else None
        return {"started_at": s.first, "ended_at": s.last + self.gap, "n_events": s.n, "run_status": status, "stopped_before": stopped, "stages": stages}

    def close(self) -> None:
        pass


def stream_run_stages(events: DataFrame, watermark: str, gap_seconds: float, stages: tuple[str, ...] = AGENTS) -> DataFrame:
    """The same of a stream; needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    rows = events.withWatermark("ts", watermark).filter("ts IS NOT NULL").select("ts", "run_id", F.unix_micros("ts").alias("us"), "event", "agent")
    out = rows.groupBy("run_id").transformWithState(Sessions(round(gap_seconds * 1e6), tuple(stages)), "run_id long, us string", "append", "eventTime")
    raw = "started_at long, ended_at long, n_events long, run_status string, stopped_before string, stages array<struct<agent:string,status:string,starts:long,failures:long,last_at:long>>"
    s = F.from_json("us", raw)
    at = F.timestamp_micros
    stage = lambda x: F.struct(x["agent"].alias("agent"), x["status"].alias("status"), x["starts"].alias("starts"), x["failures"].alias("failures"), at(x["last_at"]).alias("last_at"))
    made = out.select("run_id", s.alias("s"))
    return made.select("run_id", at("s.started_at").alias("started_at"), at("s.ended_at").alias("ended_at"), "s.n_events", "s.run_status", "s.stopped_before", F.transform("s.stages", stage).alias("stages"))
