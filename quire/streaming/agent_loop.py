"""The agent's loop as a keyed state machine over the log of calls: progress, retries, narrowed scopes, fall-back and stops.

Calls of a task may arrive in any order within the lateness; they wait in the state until the watermark passes them and are then
taken in order of time. A timer ends a task at its deadline. Everything the loop knows is in the state and follows from the
log alone, so a run that is taken up again, or replayed from the start, gives the same rows.

Rules, for each call that isn't stale (its call was accepted before) and comes before the end:
* at 12 idle steps a task without open work is finished; a review with open work turns to the fall-back policy and counts anew,
  and stops at 12 more; an upgrade stops at 36;
* an action that made no progress three times on its target is not tried again: the target is noted as unverified, which is progress;
* an answer over budget, or a second match without progress, narrows the scope to half of what was selected, at least two ids;
* three invalid answers in a row put the fall-back policy in charge until there is progress."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from quire.plans.registry import query
from quire.sources.files import scratch
from quire.streaming.calls import event_stream

# Idle steps of a review and of an upgrade, tries of an action, invalid answers, ids of an action.
IDLE, UPGRADE_IDLE, TRIES, INVALID, MOST_IDS = 12, 36, 3, 3, 32
DEADLINE_MS = 10 * 24 * 3600 * 1000
CALL = ["ts", "event_id", "call", "kind", "operation", "outcome", "selected", "target", "open"]
CALL_TYPES = "ts long, event_id long, call string, kind string, operation string, outcome string, selected int, target string, open boolean"
OUT = "task long, event_id long, place int, verdict string, mode string, idle int, failures int, most_ids int"
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@dataclass
class Progress:
    """What a task's loop knows."""

    first: int | None = None
    over: bool = False
    place: int = 0
    idle: int = 0
    failures: int = 0
    fallback: bool = False
    most_ids: int = MOST_IDS
    tries: dict[str, int] = field(default_factory=dict)
    accepted: list[str] = field(default_factory=list)

    def narrowed(self, selected: int) -> None:
        self.most_ids = max(2, min(self.most_ids - 1, selected // 2))

    def moved(self, target: str) -> None:
        self.idle = self.failures = 0
        self.tries.pop(target, None)

    def stop(self, kind: str, open_: bool) -> str | None:
        """Whether the loop ends before its next step; a review may turn to the fall-back policy instead."""
        if self.idle >= IDLE and not open_:
            return "finished"
        if kind == "upgrade":
            return "stopped by steps" if self.idle >= UPGRADE_IDLE else None
        if self.idle >= IDLE and self.fallback:
            return "stopped by steps"
        if self.idle >= IDLE:
            self.fallback, self.idle = True, 0
        return None

    def taken(self, call: dict) -> str:
        """What a call comes to."""
        if self.over:
            return "after the end"
        if call["call"] in self.accepted:
            return "stale"
        ended = self.stop(call["kind"], call["open"])
        if ended:
            self.over = True
            return ended
        target, matching, before = call["target"], call["operation"] == "match", self.tries.get(call["target"], 0)
        if before >= TRIES:
            self.moved(target)
            return "unverified"
        if matching and before and call["selected"] > 2:
            self.narrowed(call["selected"])
        if call["outcome"] == "succeeded":
            self.moved(target)
            self.accepted.append(call["call"])
            return "progress"
        self.idle += 1
        if call["outcome"] == "failed":
            self.failures += 1
            if self.failures >= INVALID:
                self.idle = 0
            return "invalid answer"
        self.tries[target] = before + 1
        if call["outcome"] == "partial":
            return "no progress"
        if matching and call["selected"] > 2:
            self.narrowed(call["selected"])
        elif matching:
            self.moved(target)
            return "unverified"
        return "over budget"

    def step(self, call: dict) -> tuple:
        """The row of one call: (event_id, place, verdict, mode, idle, failures, most_ids)."""
        verdict = self.taken(call)
        self.place += 1
        return (call["event_id"], self.place, verdict, self.mode(), self.idle, self.failures, self.most_ids)

    def mode(self) -> str:
        return "fallback" if self.fallback or self.failures >= INVALID else "chosen"


class AgentLoop(StatefulProcessor):
    """State of a task: its progress, and the calls that the watermark hasn't passed."""

    def __init__(self, deadline_ms: int):
        self.deadline_ms = deadline_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", "value string")
        self.waiting = handle.getListState("waiting", CALL_TYPES)

    def known(self) -> Progress:
        return Progress(**json.loads(self.progress.get()[0])) if self.progress.exists() else Progress()

    def rows(self, key, out: list[tuple]):
        import pandas as pd

        kinds = {"task": "int64", "event_id": "Int64", "place": "int32", "idle": "int32", "failures": "int32", "most_ids": "int32"}
        names = [c.split()[0] for c in OUT.split(", ")]
        return pd.DataFrame([(int(key[0]), *r) for r in out], columns=names).astype(kinds)

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:  # noqa: N803  names of the interface
        calls = [tuple(r) for pdf in rows for r in pdf[CALL].itertuples(index=False)]
        if calls:
            calls = [(int(c[0]), int(c[1]), *c[2:6], int(c[6]), c[7], bool(c[8])) for c in calls]
            self.waiting.appendList(calls)
            self.handle.registerTimer(min(c[0] for c in calls))
        yield self.rows(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N803
        passed, p = timerValues.getCurrentWatermarkInMs(), self.known()
        calls = [dict(zip(CALL, c, strict=True)) for c in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((c for c in calls if c["ts"] <= passed), key=lambda c: (c["ts"], c["event_id"]))
        later = [tuple(c[n] for n in CALL) for c in calls if c["ts"] > passed]
        out = []
        for call in due:
            if p.first is None:
                p.first = call["ts"]
                self.handle.registerTimer(p.first + self.deadline_ms)
            if call["ts"] >= p.first + self.deadline_ms:
                out += self.expired(p)
            out.append(p.step(call))
        if p.first is not None and passed >= p.first + self.deadline_ms:
            out += self.expired(p)
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
            if later:
                self.handle.registerTimer(min(c[0] for c in later))
        self.progress.update((json.dumps(asdict(p)),))
        yield self.rows(key, out)

    def expired(self, p: Progress) -> list[tuple]:
        """The end at the deadline, a row without a call, once."""
        if p.over:
            return []
        p.over = True
        return [(None, p.place, "stopped by time", p.mode(), p.idle, p.failures, p.most_ids)]

    def close(self) -> None:
        pass


def agent_loop_rows(calls: DataFrame, *, deadline_ms: int = DEADLINE_MS, late: str = "0 seconds") -> DataFrame:
    """A row for each call of a stream (task, time, and the columns of CALL), as the watermark passes it, and for each end by time."""
    return calls.withWatermark("time", late).groupBy("task").transformWithStateInPandas(AgentLoop(deadline_ms), OUT, "Append", "EventTime")


def taken_up(rows: DataFrame, out: str, progress: str) -> None:
    """All that is there now run through the stream, from where an earlier run with the same folders ended."""
    spark = rows.sparkSession
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)  # the store that keeps lists and timers
    try:
        q = rows.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        finally:
            q.stop()
    finally:
        spark.conf.unset(PROVIDER[0]) if before is None else spark.conf.set(PROVIDER[0], before)


def calls_of(events: DataFrame) -> DataFrame:
    """Events as calls of the loop: five outcomes, twelve targets a task, calls that come again."""
    e = F.col("event_id")
    named = lambda by, *names: F.element_at(F.array(*map(F.lit, names)), (F.pmod(by, F.lit(len(names))) + 1).cast("int"))
    operation: Column = named(e, "match", "evaluate", "recheck", "match")
    outcome = named(F.floor(e / 7), "failed", "partial", "processing", "partial", "succeeded", "partial")
    return events.select(
        F.col("user_id").alias("task"), F.col("ts").alias("time"), F.unix_millis("ts").alias("ts"), "event_id", F.concat(F.lit("c"), F.pmod(e, F.lit(64))).alias("call"),
        F.when(F.col("user_id") % 2 == 0, "review").otherwise("upgrade").alias("kind"), operation.alias("operation"), outcome.alias("outcome"),
        (F.pmod(F.floor(e / 3), F.lit(9)) + 1).cast("int").alias("selected"), F.concat_ws(":", operation, F.pmod(F.floor(e / 4), F.lit(3))).alias("target"), (F.pmod(e, F.lit(3)) > 0).alias("open"),
    )


@query()
def agent_loop(spark, sf_dir):
    """The loop over every task's events, from a stream."""
    out = scratch(spark, "agent-loop")
    taken_up(agent_loop_rows(calls_of(event_stream(spark, sf_dir))), out, f"{out}-progress")
    return spark.read.schema(OUT).parquet(out)
