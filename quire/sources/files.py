"""Readers and writers of the document model's files: JSON documents, run records, glossaries, logs, manifests, Markdown."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN = "struct<id:string,kind:string,source:string,translated:string,revised:string,marks:array<string>,href:string>"
UNIT = f"struct<id:string,spans:array<{SPAN}>>"
IMAGE = f"struct<id:string,asset_path:string,alt_text:string,width_pt:double,height_pt:double,caption:{UNIT}>"
CELL = f"struct<id:string,row:int,column:int,header:boolean,content:{UNIT},images:array<{IMAGE}>>"
BLOCK = f"struct<id:string,`order`:int,kind:string,bbox:array<double>,content:{UNIT},caption:{UNIT},image:{IMAGE},cells:array<{CELL}>,level:int,ordered:boolean,checked:boolean,language:string,alert_kind:string>"
DOCUMENT = f"schema_version int, pages array<struct<number:int,width:double,height:double,blocks:array<{BLOCK}>>>, metadata map<string,string>, _corrupt string"
CALL = "call_id string, operation string, status string, round int, attempts int, fingerprint string, response_sha256 string, updated_at timestamp, _corrupt string"
RECORD = "translation_id string, review_id string, register_id string, status string, created_at timestamp, updated_at timestamp, _corrupt string"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder of spark.checkpoint.dir; a local one only on one machine where that is unset."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        d = "file://" + tempfile.mkdtemp(prefix="quire-checkpoint-")
        spark.sparkContext.setCheckpointDir(d)
    return f"{d.rstrip('/')}/quire-{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, so that rounds don't repeat what came before them."""
    path = scratch(df.sparkSession, "settled")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quire_path = path
    return out


def still_there(df: DataFrame) -> bool:
    """Whether every file of a table of settled() is still in the shared folder, which others may clear."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in df.inputFiles()]
    return all(p.getFileSystem(conf).exists(p) for p in paths)


def unsettled(df: DataFrame) -> None:
    """Deletes a table of settled() that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._quire_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents, one a file; unknown fields are left out and a broken file is a row with _corrupt."""
    df = spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return df.withColumn("file", F.col("_metadata.file_path"))


def flatten(documents: DataFrame) -> DataFrame:
    """(file, page, ord, lane, row, col, nth, unit_id, text) of all units: content, caption, image caption, cells, image captions of cells.

    Reading order is that of the first columns: a cell's captions follow it by nth."""
    pages = documents.select("file", F.explode("pages").alias("p"))
    blocks = pages.select("file", F.col("p.number").alias("page"), F.explode("p.blocks").alias("b"))
    base = ["file", "page", F.col("b.order").alias("ord")]
    lane = lambda k, unit: blocks.select(*base, F.lit(k).alias("lane"), F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit(0).alias("nth"), unit.alias("u"))
    captions = F.transform(F.coalesce("c.images", F.array()), lambda x: x["caption"])
    of_cell = F.posexplode(F.concat(F.array("c.content"), captions)).alias("nth", "u")
    cells = blocks.select(*base, F.lit(3).alias("lane"), F.explode("b.cells").alias("c")).select("file", "page", "ord", "lane", F.col("c.row").alias("row"), F.col("c.column").alias("col"), of_cell)
    units = lane(0, F.col("b.content")).unionByName(lane(1, F.col("b.caption"))).unionByName(lane(2, F.col("b.image.caption"))).unionByName(cells)
    text = F.array_join(F.transform("u.spans", lambda s: F.when(s["kind"] == "line_break", "\n").otherwise(F.coalesce(s["translated"], s["source"]))), "")
    return units.where("u IS NOT NULL").select("file", "page", "ord", "lane", "row", "col", "nth", F.col("u.id").alias("unit_id"), text.alias("text"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Run records; a broken one is a row with the file's time, so a listing shows it."""
    df = spark.read.schema(RECORD).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    run = F.coalesce("translation_id", "review_id", "register_id")
    return df.select(run.alias("run_id"), F.when(F.col("_corrupt").isNotNull(), "broken").otherwise(F.col("status")).alias("status"), F.coalesce("updated_at", F.col("_metadata.file_modification_time")).alias("updated_at"))


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """Calls of a log, one JSON file each; a broken file is left out."""
    df = spark.read.schema(CALL).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return df.where("_corrupt IS NULL AND call_id IS NOT NULL").drop("_corrupt")


def read_untyped(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): JSON files as variants, for fields that no schema names; null where a file isn't JSON."""
    df = spark.read.text(path, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("value"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(file, json_name, json, assets array<name, size>, problem) of ZIP archives: exactly one JSON document, assets below artifacts/.

    Entries outside the archive's folder, links, names that differ in case only, and other files are a problem; such an archive has no json."""
    import zipfile

    def run(batches):
        import io

        import pandas as pd

        for pdf in batches:
            out = []
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                name, text, assets, problem, seen = None, None, [], None, set()
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for e in z.infolist():
                            parts = e.filename.rstrip("/").split("/")
                            if e.filename.startswith("/") or "\\" in e.filename or ".." in parts or (e.external_attr >> 16) & 0o170000 == 0o120000:
                                problem = problem or "unsafe entry"
                            elif e.filename.casefold() in seen:
                                problem = problem or "duplicate entry"
                            elif not e.is_dir():
                                if e.filename.lower().endswith(".json") and len(parts) == 1:
                                    problem = problem or ("several documents" if name else None)
                                    name, text = e.filename, z.read(e).decode("utf-8", "replace")
                                elif parts[0] == "artifacts" and len(parts) > 1:
                                    assets.append({"name": e.filename, "size": e.file_size})
                                else:
                                    problem = problem or "unknown entry"
                            seen.add(e.filename.casefold())
                        problem = problem or (None if name else "no document")
                except zipfile.BadZipFile:
                    problem = "not an archive"
                out.append((file, name, None if problem else text, assets, problem))
            yield pd.DataFrame(out, columns=["file", "json_name", "json", "assets", "problem"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, json_name string, json string, assets array<struct<name:string,size:long>>, problem string")


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """Glossary rows; a byte-order mark is no part of the first name, and names are in lower case."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    return df.toDF(*[c.lstrip("﻿").strip().lower() for c in df.columns])


def read_log_counts(spark: SparkSession, path: str, classes: dict[str, str]) -> DataFrame:
    """Lines of text logs by file that contain a class's mark."""
    df = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_name").alias("file"))
    return df.groupBy("file").agg(*[F.count_if(F.col("value").contains(mark)).alias(name) for name, mark in classes.items()])


def manifest(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path below root, size, sha256) of all files."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/").split(":", 1)[-1].replace("///", "/")
    return df.select(F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), f"^{base}/?", "").alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def write_markdown(rows: DataFrame, path: str) -> None:
    """(doc_id, markdown) as text files in a folder for each document; the commit protocol makes them whole."""
    rows.select("doc_id", F.col("markdown").alias("value")).write.partitionBy("doc_id").mode("overwrite").text(path)
