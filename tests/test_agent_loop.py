"""The agent's loop: the stream against a plain loop over the same events."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quire.sources.files import scratch
from quire.streaming import agent_loop as A
from quire.streaming.calls import event_stream

SF = "/root/testdata/sf0.001"


def plain_loop(calls, last, deadline):
    """Rows (event_id, place, verdict, mode, idle, failures, most_ids) of one task's calls in order of time; last: the end of the log."""
    idle = bad = place = 0
    most, fixed, done, begun = 32, False, False, calls[0]["ts"]
    stuck, good, out = Counter(), set(), []

    def note(event, verdict):
        out.append((event, place, verdict, "fallback" if fixed or bad >= 3 else "chosen", idle, bad, most))

    for c in [*calls, None]:
        if not done and (c["ts"] if c else last) >= begun + deadline:
            done = True
            note(None, "stopped by time")
        if c is None:
            break
        place += 1
        if done or c["call"] in good:
            note(c["event_id"], "after the end" if done else "stale")
            continue
        if idle >= 12 and (not c["open"] or (c["kind"] == "review" and fixed) or (c["kind"] == "upgrade" and idle >= 36)):
            done = True
            note(c["event_id"], "stopped by steps" if c["open"] else "finished")
            continue
        if idle >= 12 and c["kind"] == "review":
            fixed, idle = True, 0
        halve = c["operation"] == "match" and c["selected"] > 2
        smaller = lambda: max(2, min(most - 1, c["selected"] // 2))
        if stuck[c["target"]] == 3:
            verdict = "unverified"
        else:
            if stuck[c["target"]] and halve:
                most = smaller()
            verdict = {"succeeded": "progress", "failed": "invalid answer", "partial": "no progress", "processing": "over budget"}[c["outcome"]]
            if verdict == "over budget" and halve:
                most = smaller()
            elif verdict == "over budget" and c["operation"] == "match":
                verdict = "unverified"
        if verdict in ("unverified", "progress"):
            idle = bad = stuck[c["target"]] = 0
            if verdict == "progress":
                good.add(c["call"])
        elif verdict == "invalid answer":
            bad += 1
            idle = 0 if bad >= 3 else idle + 1
        else:
            idle, stuck[c["target"]] = idle + 1, stuck[c["target"]] + 1
        note(c["event_id"], verdict)
    return out


def want(df, deadline):
    tasks, rows = defaultdict(list), [r.asDict() for r in A.calls_of(df).collect()]
    for r in sorted(rows, key=lambda r: (r["ts"], r["event_id"])):
        tasks[r["task"]].append(r)
    last = max(r["ts"] for r in rows)
    return sorted(((t, *x) for t, calls in tasks.items() for x in plain_loop(calls, last, deadline)), key=str)


def test_stream_equals_plain_loop(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    expected = want(events, A.DEADLINE_MS)
    assert sorted(map(tuple, A.agent_loop(spark, SF).collect()), key=str) == expected
    assert {"progress", "stale", "unverified", "no progress", "over budget", "invalid answer", "stopped by time"} <= {r[3] for r in expected}


def test_a_run_taken_up_again_gives_the_same_rows(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    folder, out = scratch(spark, "log"), scratch(spark, "loop")
    deadline = 25 * 24 * 3600 * 1000
    cut = [F.col("ts") < "2024-01-09", (F.col("ts") >= "2024-01-09") & (F.col("ts") < "2024-01-20"), F.col("ts") >= "2024-01-20"]
    for k, part in enumerate(cut):
        events.where(part).repartition(3, "event_id").write.parquet(f"{folder}/events-{k}.parquet")
        stream = event_stream(spark, f"{folder}/*", "*.parquet", events.schema)
        A.taken_up(A.agent_loop_rows(A.calls_of(stream), deadline_ms=deadline), out, f"{out}-progress")
    got = sorted(map(tuple, spark.read.schema(A.OUT).parquet(out).collect()), key=str)
    expected = want(events.withColumn("ts", F.col("ts").cast("timestamp")), deadline)
    assert got == expected and {"finished", "stopped by steps", "after the end"} & {r[3] for r in expected}
