"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only on one machine (tests), where it is unset, a local folder is made and set; a cluster without it is refused."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        d = "file://" + tempfile.mkdtemp(prefix="quire-checkpoint-")
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder."""
    return f"{shared_dir(spark)}/quire-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quire_path = path
    return out


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """df as a table in the warehouse (shared, too) in buckets of key: joins on key don't move it again."""
    spark, name = df.sparkSession, f"quire_{uuid.uuid4().hex}"
    df.write.bucketBy(shuffle_partitions(spark), key).saveAsTable(name)
    out = spark.table(name)
    out._quire_table = name
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table made by written() or bucketed() that nothing reads any more."""
    if getattr(df, "_quire_table", None):
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._quire_table}")
    path = getattr(df, "_quire_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(spark: SparkSession, size: float, each: float = 128e6) -> int:
    """As many as the session shuffles into, or more, so that none takes over `each` bytes of `size`."""
    return max(shuffle_partitions(spark), int(size // each) + 1)


#: Rows of a small table that go into one file.
ROWS_A_FILE = 100_000


def files_for(spark: SparkSession, rows: int) -> int:
    """How many files a table of so many short rows is written in: one for each core, or more. A file in a local store costs some processes that
    the executor's JVM starts, so that a small table in one file for each shuffle partition is dear."""
    return max(spark.sparkContext.defaultParallelism, rows // ROWS_A_FILE + 1)


class Memo(dict):
    """make(key) of each key; of two generations of at most `keep` keys the elder is forgotten."""

    def __init__(self, make, keep: int):
        super().__init__()
        self.make, self.keep, self.old = make, keep, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= self.keep:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


#: What a Python worker keeps from task to task.
_KEPT: list[dict] = []


def kept(cache: dict) -> dict:
    """cache, which forget() empties."""
    _KEPT.append(cache)
    return cache


def forget() -> None:
    """Empties what other operators have left in this worker, so that their memory isn't held while this one works."""
    for cache in _KEPT:
        cache.clear()


def as_objects(pdf):
    """Text columns as Python objects: Arrow-backed ones of no or several chunks can't be sent back."""
    return pdf.astype({c: object for c in pdf.columns if pdf[c].dtype.kind not in "iufbM"})


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the number as text, modulo n; null for a null number."""
    return F.crc32(col.cast("string").cast("binary")) % n


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, one for each wanted name."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


def components(edges: DataFrame, *, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: (node, root), nodes of edges only.

    Contraction: each round hangs every node under the least of its neighbours by hashed order
    (so chains of growing ids give shallow trees), follows the parents three times, and keeps
    the edges between different results.
    Each round removes a constant share of nodes, so rounds grow with the logarithm of the
    graph; every round is a written table. Null ends are ignored. The root is any node of the component."""
    spark = edges.sparkSession

    def order(c):
        return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))

    e = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct(), "edges")
    steps: list[DataFrame] = []
    while not e.isEmpty():
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min(order("b")).alias("m")).select(F.col("a").alias("node"), F.when(F.col("m") < order("a"), F.col("m.v")).otherwise(F.col("a")).alias("up"))
        parent = written(parent, "parents")
        up = parent
        for _ in range(2):  # parents of parents: up to 4 steps
            far = up.select(F.col("node").alias("up"), F.col("up").alias("far"))
            up = up.join(far, "up").select("node", F.col("far").alias("up"))
        up = written(up, "up")
        dropped(parent)
        steps.append(up)
        left = e.join(up.select(F.col("node").alias("a"), F.col("up").alias("x")), "a").join(up.select(F.col("node").alias("b"), F.col("up").alias("y")), "b")
        nxt = written(left.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        dropped(e)
        e = nxt
    if not steps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # A node that a round makes a parent may itself be merged in a later round.
    out = steps[-1].select("node", F.col("up").alias("root"))
    for up in reversed(steps[:-1]):
        later = out.select(F.col("node").alias("up"), F.col("root").alias("later"))
        out = up.join(later, "up", "left").select("node", F.coalesce("later", "up").alias("root"))
    return out


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each at most its index, of its own component) after linking a[i] with b[i]."""
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        for x in (a, b, before[a], before[b]):
            np.minimum.at(label, x, low)
        label = label[label]
        if (label == before).all():
            return label


def offsets(sizes: DataFrame, by: str, size: str) -> DataFrame:
    """(by, before): the running total of size over smaller values of by, a bounded table of partitions."""
    return sizes.select(by, (F.sum(size).over(Window.orderBy(by)) - F.col(size)).alias("before"))
