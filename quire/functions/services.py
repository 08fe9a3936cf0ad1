"""The boundary to outside services (conversion, embedding, language models): batches, retries, memo of saved calls."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stub_embedding(texts: list[str], dims: int = 16) -> list[list[float]]:
    """A stand-in that needs no network: numbers from a hash of each text."""
    return [[b / 127.5 - 1 for b in hashlib.sha256(t.encode()).digest()[:dims]] for t in texts]


def call_ids(df: DataFrame, *parts: str) -> DataFrame:
    """df with call_id, a hash of what the call depends on."""
    return df.withColumn("call_id", F.concat(F.lit("call-"), F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]), 256)))


def called(df: DataFrame, service: Callable[[list[str]], list], payload: str, *, batch: int = 16, tries: int = 5, pause: float = 0.2) -> DataFrame:
    """(call_id, response, error): the service's answers as JSON, for batches of payloads, each tried several times.

    A batch that keeps failing is halved until single payloads fail alone."""

    def ask(texts: list[str]) -> list[tuple[str | None, str | None]]:
        error = ""
        for n in range(tries):
            try:
                got = service(texts)
                if len(got) != len(texts):
                    raise ValueError(f"{len(got)} answers to {len(texts)} payloads")
                return [(json.dumps(x, ensure_ascii=False), None) for x in got]
            except Exception as e:  # the service's own failures become rows
                error = f"{type(e).__name__}: {e}"
                time.sleep(min(pause * 2**n, 5))
        if len(texts) == 1:
            return [(None, error)]
        return ask(texts[: len(texts) // 2]) + ask(texts[len(texts) // 2 :])

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                out = ask(part["payload"].tolist())
                yield pd.DataFrame({"call_id": part["call_id"].astype(object), "response": pd.Series([x[0] for x in out], dtype=object, index=part.index), "error": pd.Series([x[1] for x in out], dtype=object, index=part.index)})

    return df.select("call_id", F.col(payload).alias("payload")).mapInPandas(run, "call_id string, response string, error string")


def with_memo(df: DataFrame, saved: DataFrame, service: Callable[[list[str]], list], payload: str, **options) -> DataFrame:
    """Answers to df: saved ones whose hash of the response holds, and fresh ones for the rest.

    saved: (call_id, response, sha256)."""
    good = saved.where(F.sha2("response", 256) == F.col("sha256")).dropDuplicates(["call_id"]).select("call_id", "response", F.lit(None).cast("string").alias("error"))
    hits = good.join(df.select("call_id").distinct(), "call_id", "left_semi")
    return hits.unionByName(called(df.join(good, "call_id", "left_anti").dropDuplicates(["call_id"]), service, payload, **options))
