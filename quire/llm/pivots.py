"""Embedding near-dedup through a pivot-permutation index (operator 3).

Each vector is described by its PREFIX nearest reference points (pivots), in order. Inverted lists
hold the vectors of each pivot; two vectors of a list that share at least SHARED pivots (or what any two
must share, if that is more) are candidates, and cosine on the original vectors in double precision
decides. As candidates share several pivots, each vector is left out of its SHARED - 1 longest lists.
Pivots are vectors of the table, from those of the least hashes, none near another, at most MOST_PIVOTS
(a documented bound of the fit: beyond about 4 million vectors lists grow with the table); every vector
is indexed.

Equal vectors are compared once, with their number. A list is split into chunks, and each pair of
chunks is a group of its own, so a list of any length is whole. A pair counts in the list of its
least shared pivot only. Groups send back link counts and a spanning forest, never pairs.

Cases: vectors that are null or zero, or hold null or non-finite components, or have another length
than the valid vector whose vec_id has the least hash, link with nothing and keep their row; scaled copies have
cosine 1; repeated rows are vectors of their own; null vec_ids keep their row; an empty table gives
an empty one; other columns are not carried."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, dropped, merge, table, written

LEAST_COSINE = 0.9
PREFIX, SHARED = 10, 2
LEAST_PIVOTS, MOST_PIVOTS = 64, 8192
#: Pivots are nowhere nearer to each other than this cosine; so many vectors are looked at for each.
APART, OVERSAMPLE = 0.6, 2
CHUNK = 2048


def valid(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(rows) -> np.ndarray:
    """Unit vectors in double precision; scaled by powers of two first, so no square overflows."""
    x = np.stack([np.asarray(v, float) for v in rows])
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def pivots_for(n: int) -> int:
    """Grows as the square root of the table, so lists grow no faster than that either."""
    return int(min(MOST_PIVOTS, max(LEAST_PIVOTS, 2 ** int(np.ceil(np.log2(4 * max(n, 1) ** 0.5))))))


def first_shared(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The least pivot that rows p[i] and q[i] share."""
    met = (p[:, :, None] == q[:, None, :]).any(axis=2)
    return np.where(met, p, np.iinfo(p.dtype).max).min(axis=1)


def list_links(pivot: int, chunk: np.ndarray, x: np.ndarray, p: np.ndarray, weight: np.ndarray, least: float, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """(links of each row, component label of each row) within one list, or between two of its chunks.

    A pair is taken in the list of its least shared pivot; p: pivots by the order of their lists' lengths."""
    names, local = np.unique(p, return_inverse=True)
    member = np.zeros((len(x), len(names)), np.float32)
    member[np.arange(len(x))[:, None], local.reshape(p.shape)] = 1
    links, label, cross = np.zeros(len(x), np.int64), np.arange(len(x)), chunk.min() != chunk.max()
    for s in range(0, len(x), 512):
        e = min(s + 512, len(x))
        near = member[s:e] @ member[s:].T >= shared  # shared-pivot counts
        near &= np.arange(s, len(x))[None, :] > np.arange(s, e)[:, None]
        if cross:
            near &= chunk[s:e, None] != chunk[None, s:]
        if np.count_nonzero(near) * 8 > near.size:  # a dense list: one product for all, with some slack
            near &= x[s:e] @ x[s:].T >= least - 1e-9
        a, b = np.nonzero(near)
        for k in range(0, len(a), 100_000):
            i, j = a[k : k + 100_000] + s, b[k : k + 100_000] + s
            own = first_shared(p[i], p[j]) == pivot
            i, j = i[own], j[own]
            close = (x[i] * x[j]).sum(axis=1) >= least
            i, j = i[close], j[close]
            links += np.bincount(i, weights=weight[j], minlength=len(x)).astype(np.int64)
            links += np.bincount(j, weights=weight[i], minlength=len(x)).astype(np.int64)
            label = merge(label, i, j)
    return links, label


def spread(x: np.ndarray, most: int, apart: float = APART) -> np.ndarray:
    """The first of x that aren't near each other: a dense group gives one pivot, so its members agree on theirs."""
    kept = np.empty((min(most, len(x)), x.shape[1]))
    n = 0
    for v in x:
        if n < len(kept) and (n == 0 or (kept[:n] @ v).max() < apart):
            kept[n] = v
            n += 1
    return kept[:n]


def indexed(reps: DataFrame, prefix: int, n: int) -> tuple[DataFrame, int, int]:
    """(rid, vector, n, prefix array<int>): each vector's nearest pivots, nearest first; their number, and that of all pivots.

    Where fewer than prefix pivots are kept, each vector has them all, and one list holds every pair."""
    sample = reps.orderBy(F.xxhash64("rid"), "rid").limit(OVERSAMPLE * pivots_for(n)).select("vector").toPandas()  # bounded by OVERSAMPLE * MOST_PIVOTS
    if not len(sample):
        return reps.withColumn("prefix", F.array().cast("array<int>")), 0, 0
    pivots = spread(unit(sample["vector"]), pivots_for(n))
    k = min(prefix, len(pivots))

    def run(batches):
        for pdf in batches:
            out = []
            for s in range(0, len(pdf), 1024):
                sim = unit(pdf["vector"].iloc[s : s + 1024]) @ pivots.T
                top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
                out += list(np.take_along_axis(top, np.argsort(-np.take_along_axis(sim, top, 1), axis=1, kind="stable"), 1).astype(np.int32))
            pdf["prefix"] = out
            yield pdf

    return reps.mapInPandas(run, "rid long, vector array<double>, n long, prefix array<int>"), k, len(pivots)


def links(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", least: float = LEAST_COSINE, prefix: int = PREFIX, shared: int = SHARED, chunk: int = CHUNK) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of vectors."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    size = rows.where(valid(F.col("vector"))).agg(F.min_by(F.size("vector"), F.struct(F.xxhash64("vec_id"), "vec_id")).alias("s")).first()
    good = valid(F.col("vector")) & (F.size("vector") == (size.s or 0))
    reps = rows.where(good).groupBy("vector").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"))
    reps = written(reps.withColumn("rid", F.monotonically_increasing_id()), "distinct-vectors")
    n = reps.count()
    near_pivots, k, of = indexed(reps.select("rid", "vector", "n"), prefix, n)
    shared = max(min(shared, k), 2 * k - of)  # any two share 2 k - of
    posted = written(near_pivots, "posted")
    length = {r.pivot: r.n for r in posted.select(F.explode("prefix").alias("pivot")).groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most MOST_PIVOTS rows
    place = np.argsort(np.argsort([length.get(p, 0) for p in range(of)], kind="stable"), kind="stable").astype(np.int32)  # the shortest list first

    def by_length(prefixes):
        import pandas as pd

        return pd.Series(list(np.sort(place[np.stack(prefixes)], axis=1)) if len(prefixes) else [], dtype=object)

    ordered = posted.withColumn("prefix", F.pandas_udf(by_length, "array<int>", F.PandasUDFType.SCALAR)("prefix"))
    sizes = spark.createDataFrame([(int(place[p]), -(-x // chunk)) for p, x in length.items()] or [(0, 1)], "pivot int, k int")
    entry = ordered.select("rid", "vector", "n", "prefix", F.explode(F.slice("prefix", 1, max(1, k - shared + 1))).alias("pivot")).join(F.broadcast(sizes), "pivot")
    entry = entry.withColumn("chunk", F.pmod(F.xxhash64("rid"), F.col("k")).cast("int"))
    other = F.explode(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.struct(F.least("chunk", j).alias("x"), F.greatest("chunk", j).alias("y"))))
    entry = entry.withColumn("pair", other).select("pivot", "pair.x", "pair.y", "chunk", "rid", "vector", "n", "prefix")

    def run(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("rid")
        rid = pdf["rid"].to_numpy()
        count, label = list_links(key[0], pdf["chunk"].to_numpy() if key[1] != key[2] else np.zeros(len(pdf), int), unit(pdf["vector"]), np.stack(pdf["prefix"]), pdf["n"].to_numpy(), least, shared)
        linked = count > 0
        return pd.DataFrame({"rid": rid[linked], "links": count[linked], "root": rid[label][linked]})

    found = written(entry.groupBy("pivot", "x", "y").applyInPandas(run, "rid long, links long, root long"), "links")
    comp = components(found.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    per = reps.join(found.groupBy("rid").agg(F.sum("links").alias("links")), "rid", "left").join(comp, F.col("rid") == F.col("node"), "left").select("vector", "n", "first_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "rid").alias("root"))
    ids = per.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = written(per.join(ids, "root").select(F.col("vector").alias("v"), (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id"), "named")
    dropped(posted)
    keyed = rows.withColumn("v0", F.when(good, F.col("vector")))
    out = keyed.join(named, F.col("v0") == F.col("v"), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op3_pivot_permutations(spark, sf_dir):
    return links(table(spark, sf_dir, "embeddings"))
