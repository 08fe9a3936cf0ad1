"""Files, services and streams."""

import json

from pyspark.sql import functions as F

from quire.functions import services
from quire.sources import files
from quire.streaming import calls


def unit(i, *spans):
    return {"id": i, "spans": [{"id": f"{i}/s{k}", "kind": kind, "source": s, "translated": t} for k, (kind, s, t) in enumerate(spans)]}


def test_documents(spark, tmp_path):
    doc = {"schema_version": 1, "extra": 1, "metadata": {"a": "b"}, "pages": [{"number": 1, "blocks": [
        {"id": "b1", "order": 0, "kind": "heading", "content": unit("u1", ("text", "one", None), ("line_break", "", None), ("text", "two", ""))},
        {"id": "b2", "order": 1, "kind": "table", "caption": unit("u2", ("text", "cap", "CAP")), "cells": [{"id": "c", "row": 0, "column": 1, "header": True, "content": unit("u3", ("text", "x", None))}]}]}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    (tmp_path / "b.json").write_text("{broken")
    df = files.read_documents(spark, str(tmp_path))
    assert sum(r._corrupt is not None for r in df.select("file", "schema_version", "_corrupt").collect()) == 1
    got = files.flatten(df).orderBy("page", "ord", "lane", "row", "col").select("unit_id", "text").collect()
    assert [tuple(r) for r in got] == [("u1", "one\n"), ("u2", "CAP"), ("u3", "x")]


def test_records_glossary_logs_manifest_markdown(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "1.json").write_text(json.dumps({"review_id": "r1", "status": "succeeded", "updated_at": "2024-01-01T00:00:00Z"}))
    (tmp_path / "r" / "2.json").write_text("nothing")
    assert {r.status for r in files.read_records(spark, str(tmp_path / "r")).collect()} == {"succeeded", "broken"}
    (tmp_path / "g.csv").write_text('﻿Term,Note\n"a ""b""","two\nlines"\n', encoding="utf-8")
    g = files.read_glossary(spark, str(tmp_path / "g.csv")).first()
    assert g.term == 'a "b"' and g.note == "two\nlines"
    (tmp_path / "x.log").write_text("POST ok\nPOST fail\nGET\n")
    assert files.read_log_counts(spark, str(tmp_path / "x.log"), {"posts": "POST", "failed": "fail"}).first()[1:] == (2, 1)
    m = files.manifest(spark, str(tmp_path), "*.csv").first()
    assert m.path == "g.csv" and len(m.sha256) == 64
    files.write_markdown(spark.createDataFrame([(1, "# a\n\nb")], "doc_id long, markdown string"), str(tmp_path / "md"))
    assert "# a" in spark.read.text(str(tmp_path / "md")).select(F.concat_ws("|", F.collect_list("value"))).first()[0]


def test_services(spark):
    df = services.call_ids(spark.createDataFrame([(i, f"text {i}" if i != 3 else "bad") for i in range(20)], "id long, text string"), "text")

    def service(texts):
        if "bad" in texts:
            raise RuntimeError("refused")
        return services.stub_embedding(texts, 4)

    got = services.called(df, service, "text", batch=8, tries=1, pause=0).collect()
    assert len(got) == 20 and sum(r.error is not None for r in got) == 1
    saved = df.limit(5).select("call_id", F.lit("[1]").alias("response")).withColumn("sha256", F.when(F.col("call_id") > "call-8", "wrong").otherwise(F.sha2("response", 256)))
    n = saved.where("sha256 <> 'wrong'").count()
    out = services.with_memo(df, saved, service, "text", batch=8, tries=1, pause=0).collect()
    assert len(out) == 20 and sum(r.response == "[1]" for r in out) == n


def test_stream_takes_late_and_repeated_events_once(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1, "click"), (1, "2024-01-01 00:00:00", 1, "click"), (2, "2024-01-01 00:10:00", 1, "view")]
    df = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string").select("event_id", F.to_timestamp("t").alias("ts"), "user_id", "event_type")
    for k in range(2):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "events.parquet"))
    got = calls.drained(calls.last_states(stream), "last").collect()
    assert [(r.user_id, r.event_id, r.event_type) for r in got] == [(1, 2, "view")]


def test_last_update_of_a_key_stands(spark, tmp_path):
    rows = [(1, "2024-01-01 00:10:00", "a"), (2, "2024-01-01 00:20:00", "a"), (3, "2024-01-01 01:10:00", "b"), (4, "2024-01-01 00:30:00", "a")]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "event_id long, ts string, event_type string").selectExpr("event_id", "timestamp(ts) AS ts", "event_type").coalesce(1).write.parquet(f"{tmp_path}/{i}")
    stream = spark.readStream.schema("event_id long, ts timestamp, event_type string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*")
    got = calls.drained(calls.window_counts(stream, "1 hour", late="2 hours"), "updates", "start", "event_type")
    assert sorted((str(r.start), r.event_type, r.n) for r in got.collect()) == [("2024-01-01 00:00:00", "a", 3), ("2024-01-01 01:00:00", "b", 1)]
