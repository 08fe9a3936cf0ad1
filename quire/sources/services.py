"""Outside services as Spark data sources: conversion of files (submit, poll, download) and a store of vectors (upsert, then delete what is replaced).

Both survive a lost task and a job that runs again: a file's task is named by its content, so a second submission finds the first one; a
point's id follows from what it is, so a second upsert overwrites it; and old points go only when every task of the job has written its own.

    spark.dataSource.register(Conversions); spark.read.format("conversions").option("service", url).load(folder)
    spark.dataSource.register(Points); df.write.format("points").option("service", url).option("collection", name).mode("append").save()"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Answers after which a request is sent again, and for how long at most, and how often (seconds).
AGAIN, OUTAGE, WAIT = (408, 425, 429, 500, 502, 503, 504), 1800.0, 30.0
#: Points of one request, files of one task.
POINTS, FILES = 64, 8


class Refused(Exception):
    """An answer that sending again won't change."""


@dataclass
class Service:
    """Requests to one address, sent again through an outage."""

    url: str
    outage: float = OUTAGE
    wait: float = WAIT
    tries: int = 0

    def send(self, method: str, path: str, body: bytes | None = None) -> bytes:
        end = time.monotonic() + self.outage
        while True:
            self.tries += 1
            request = urllib.request.Request(f"{self.url.rstrip('/')}/{path}", data=body, method=method, headers={"Content-Type": "application/json"})
            try:
                with urllib.request.urlopen(request, timeout=max(1.0, self.wait * 4)) as answer:
                    return answer.read()
            except urllib.error.HTTPError as e:
                if e.code not in AGAIN:
                    raise Refused(f"{e.code} {e.reason}") from e
                problem: Exception = e
            except (urllib.error.URLError, ConnectionError, TimeoutError) as e:
                problem = e
            if time.monotonic() + self.wait > end:
                raise TimeoutError(f"{method} {path}: {problem}") from problem
            time.sleep(self.wait)

    def converted(self, name: str, content: bytes) -> bytes:
        """The result for a file: submitted under the hash of its content, waited for, fetched."""
        key = hashlib.sha256(content).hexdigest()
        self.send("PUT", f"tasks/{key}", content)
        end = time.monotonic() + self.outage
        while True:
            state = json.loads(self.send("GET", f"tasks/{key}"))["state"]
            if state == "done":
                return self.send("GET", f"tasks/{key}/result")
            if state == "failed":
                raise Refused(f"conversion of {name} failed")
            if time.monotonic() + self.wait > end:
                raise TimeoutError(f"conversion of {name} is not done")
            time.sleep(self.wait)


def service_of(options: dict) -> Service:
    return Service(options["service"], float(options.get("outage", OUTAGE)), float(options.get("wait", WAIT)))


@dataclass
class Files(InputPartition):
    paths: list[str]


class ConversionReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Files]:
        """The folder's files by name, a few to a task."""
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.options["path"]) if "://" in self.options["path"] else (fs.LocalFileSystem(), self.options["path"].removeprefix("file:"))
        ending, each = self.options.get("suffix", "").casefold(), int(self.options.get("files", FILES))
        found = sorted(f.path for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and f.path.casefold().endswith(ending))
        return [Files(found[i : i + each]) for i in range(0, len(found), each)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        """A row for each file; a refused one has its problem in place of a result, an outage ends the task."""
        from pyarrow import fs

        store = fs.FileSystem.from_uri(self.options["path"])[0] if "://" in self.options["path"] else fs.LocalFileSystem()
        for path in partition.paths:
            with store.open_input_stream(path) as f:
                content = f.read()
            service, result, problem = service_of(self.options), None, None
            try:
                result = service.converted(path, content).decode("utf-8", "replace")
            except Refused as e:
                problem = str(e)
            yield path, hashlib.sha256(content).hexdigest(), result, service.tries, problem


class Conversions(DataSource):
    """Files of a folder as the results of a conversion service. Options: service, suffix, files (of a task), outage, wait (seconds)."""

    @classmethod
    def name(cls) -> str:
        return "conversions"

    def schema(self) -> str:
        return "path string, sha256 string, result string, tries int, problem string"

    def reader(self, schema) -> ConversionReader:
        return ConversionReader(dict(self.options))


@dataclass
class Written(WriterCommitMessage):
    """What one task has written: its points, and the revision of each source key."""

    points: int
    revisions: dict[str, str]


def point_id(source_key: str, logical_path: str, revision: str, chunk_index: int) -> str:
    """The same for the same chunk of the same revision, whoever writes it and how often."""
    return str(uuid.uuid5(uuid.NAMESPACE_URL, json.dumps([source_key, logical_path, revision, chunk_index])))


class PointWriter(DataSourceArrowWriter):
    """Rows (source_key, logical_path, revision, chunk_index, vector, ...) as points; further columns are their payload."""

    def __init__(self, options: dict):
        self.options = options

    def at(self, rest: str) -> str:
        return f"collections/{self.options['collection']}{rest}"

    def write(self, iterator: Iterator) -> Written:
        service, held, n, revisions = service_of(self.options), [], 0, {}
        size = int(self.options["size"])

        def put() -> None:
            service.send("PUT", self.at("/points"), json.dumps({"points": held}).encode())
            held.clear()

        for batch in iterator:
            for row in batch.to_pylist():
                vector = row.pop("vector")
                if vector is None or len(vector) != size:
                    raise ValueError(f"a vector of {row['logical_path']} doesn't have {size} numbers")
                held.append({"id": point_id(row["source_key"], row["logical_path"], row["revision"], row["chunk_index"]), "vector": vector, "payload": row})
                if revisions.setdefault(row["source_key"], row["revision"]) != row["revision"]:
                    raise ValueError(f"{row['source_key']} comes in two revisions")
                n += 1
                if len(held) >= POINTS:
                    put()
        if held:
            put()
        return Written(n, revisions)

    def commit(self, messages: list[Written | None]) -> None:
        """Every task has written: points of the same sources in other revisions go."""
        service, revisions = service_of(self.options), {}
        for m in messages:
            for key, revision in (m.revisions if m else {}).items():
                if revisions.setdefault(key, revision) != revision:
                    raise ValueError(f"{key} comes in two revisions")
        for key, revision in sorted(revisions.items()):
            service.send("POST", self.at("/points/delete"), json.dumps({"must": {"source_key": key}, "must_not": {"revision": revision}}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Old points stay; those written so far have the ids that the next run gives them."""


class Points(DataSource):
    """A collection of a vector store. Options: service, collection, size (numbers of a vector), outage, wait (seconds)."""

    @classmethod
    def name(cls) -> str:
        return "points"

    def writer(self, schema, overwrite: bool) -> PointWriter:
        options = dict(self.options)
        service_of(options).send("PUT", f"collections/{options['collection']}", json.dumps({"size": int(options["size"]), "distance": "Cosine"}).encode())
        return PointWriter(options)
