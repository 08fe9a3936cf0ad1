"""Approximate nearest neighbours by multi-index hashing of learned binary codes (operator 6).

TURNS rotations learned on at most FIT_ROWS vectors (principal axes, then iterative quantisation from
different starts) turn each vector into a code of TURNS times as many bits as it has dimensions (64 at
most). Codes are split into m substrings, each with a table from value to rows. If two codes differ in
at most R bits, one of their substrings differs in at most R // m: probing the tables within that (by all
values that near, or by those present, whichever are fewer) and verifying the whole code retrieves every
row within R. Those rows are ranked by cosine of the original vectors in double precision. R is the
smallest radius that holds the share RECALL of the sample's own neighbours (farther than those in the
whole table), at every size of table; a query that finds fewer than k in a block takes the k nearest
codes there. m is the number of substrings of least estimated work.

All rows are indexed, in blocks of at most BLOCK rows; queries form blocks too, each pair of blocks
is a task's group, and the best of each block are merged.

Cases: vectors that are null or zero, hold null or non-finite components or have another length
than the valid vector whose vec_id has the least hash take no part; rows with the query's vec_id are not its candidates;
ties go to the smaller vec_id; fewer candidates give fewer rows; repeated query rows are answered
once; an empty table gives an empty one; other columns are not carried."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, table
from .pivots import valid

FIT_ROWS, FIT_QUERIES, ROUNDS, RECALL = 20_000, 400, 30, 0.98
TURNS = 4
BLOCK, QUERY_BLOCK = 16_384, 32_768


def scaled(rows) -> np.ndarray:
    """Scaled by powers of two, which is exact, so that no square overflows."""
    x = np.stack([np.asarray(v, float) for v in rows])
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def learn(x: np.ndarray, rounds: int = ROUNDS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(mean, rotation) of unit vectors x."""
    mean = x.mean(axis=0)
    bits = min(64, x.shape[1])
    _, axes = np.linalg.eigh((x - mean).T @ (x - mean))
    axes = axes[:, ::-1][:, :bits]
    v = (x - mean) @ axes
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
        turn = (u @ w).T
    return mean, axes @ turn


def codes(x: np.ndarray, mean: np.ndarray, rotations: list[np.ndarray]) -> np.ndarray:
    """(rows, rotations): 64 bits at most from each rotation."""
    out = np.zeros((len(x), len(rotations), 8), "u1")
    for k, rotation in enumerate(rotations):
        bits = np.packbits((x - mean) @ rotation >= 0, axis=1, bitorder="little")
        out[:, k, : bits.shape[1]] = bits
    return out.view("<u8")[:, :, 0]


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which codes differ."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def best_of(sims: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest, ties to smaller ids."""
    return np.lexsort((ids, -sims))[:k]


def calibrated(x: np.ndarray, code: np.ndarray, k: int, recall: float = RECALL) -> int:
    """The radius that holds the share `recall` of the k nearest of some vectors."""
    far = [np.zeros(1, np.int64)]
    for i in range(0, len(x) if len(x) > 1 else 0, max(1, len(x) // FIT_QUERIES)):
        s = x @ x[i]
        s[i] = -np.inf
        n = min(k, len(x) - 1)
        far.append(apart(code[np.argpartition(-s, n - 1)[:n]], code[i]))
    return int(np.quantile(np.concatenate(far), recall, method="higher"))


def substrings_for(bits: int, words: int, radius: int, rows: int) -> int:
    """How many substrings cost least: values looked at and rows fetched in a block. Each lies in one word of `bits` bits."""

    def cost(m: int) -> float:
        w, t = bits * words // m, radius // m
        within = sum(comb(w, j) for j in range(min(t, w) + 1))
        return m * (min(within, rows) + rows * min(1.0, within / 2**w))

    return min((words * j for j in (1, 2, 4, 8) if j == 1 or bits // j >= 4), key=cost)


class BlockIndex:
    """Substring tables of one block's codes (rows, words); m, a multiple of the words, substrings of `bits` bits a word."""

    def __init__(self, code: np.ndarray, bits: int, m: int):
        self.code, self.m, self.parts, self.masks = code, m, [], {}
        cuts = np.linspace(0, bits, m // code.shape[1] + 1).astype(int)
        for word in range(code.shape[1]):
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                mask = np.uint64((1 << int(e - s)) - 1)
                value = (code[:, word] >> np.uint64(s)) & mask
                order = np.argsort(value, kind="stable")
                names, starts = np.unique(value[order], return_index=True)
                self.parts.append((word, np.uint64(s), mask, int(e - s), names, np.r_[starts, len(code)], order))

    def near_values(self, value: np.uint64, width: int, t: int, names: np.ndarray) -> np.ndarray:
        """Places in names of the values within t bits of value."""
        if sum(comb(width, j) for j in range(t + 1)) >= len(names):
            return np.flatnonzero(np.bitwise_count(names ^ value) <= t)
        if (width, t) not in self.masks:
            self.masks[width, t] = np.array([sum(1 << b for b in c) for j in range(t + 1) for c in combinations(range(width), j)], np.uint64)
        probe = self.masks[width, t] ^ value
        at = np.minimum(np.searchsorted(names, probe), len(names) - 1)
        return at[names[at] == probe]

    def within(self, q: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code is within radius of q."""
        met = np.zeros(len(self.code), bool)
        for word, at, mask, width, names, starts, order in self.parts:
            near = self.near_values((q[word] >> at) & mask, width, min(radius // self.m, width), names)
            sizes = starts[near + 1] - starts[near]
            met[order[np.repeat(starts[near] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]] = True
        rows = np.flatnonzero(met)
        return rows[apart(self.code[rows], q) <= radius]

    def nearest(self, q: np.ndarray, k: int) -> np.ndarray:
        """The rows whose codes are as near to q as the k-th nearest."""
        d = apart(self.code, q)
        return np.flatnonzero(d <= (np.partition(d, k - 1)[k - 1] if k <= len(d) else d.max(initial=0)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, *, vec_id: str = "vec_id", vector: str = "embedding", fit_rows: int = FIT_ROWS, recall: float = RECALL, turns: int = TURNS, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest of vectors, found by the index."""
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        got = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
        return got.where(valid(F.col("vector")) & F.col("vec_id").isNotNull())

    rows, asked = clean(vectors), clean(queries).dropDuplicates(["vec_id"])
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).toPandas()  # bounded by fit_rows
    schema = "query_id long, vec_id long, score double"
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = len(sample["vector"].iloc[0])
    sample = sample[sample["vector"].map(len) == width]
    x = scaled(sample["vector"])
    x = x / norms(x)[:, None]
    mean, rotations = x.mean(axis=0), [learn(x, seed=7 + j)[1] for j in range(turns)]
    radius = calibrated(x, codes(x, mean, rotations), k, recall)
    bits = rotations[0].shape[1]
    n, n_asked = rows.count(), asked.count()
    blocks, q_blocks = max(shuffle_partitions(spark), -(-n // block)), max(1, -(-n_asked // query_block))
    m = substrings_for(bits, turns, radius, -(-n // blocks))
    size = F.size("vector") == width
    dealt = rows.where(size).withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    asks = asked.where(size).withColumn("q", F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(key, data, asks):
        import pandas as pd

        out = []
        if len(data) and len(asks):
            ids, x, qs = data["vec_id"].to_numpy(), scaled(data["vector"]), scaled(asks["vector"])
            size, q_size = norms(x), norms(qs)
            index = BlockIndex(codes(x / size[:, None], mean, rotations), bits, m)
            for q_id, q, q_norm, code in zip(asks["vec_id"], qs, q_size, codes(qs / q_size[:, None], mean, rotations), strict=True):
                found = index.within(code, radius)
                found = found[ids[found] != q_id]
                if len(found) < k:
                    found = index.nearest(code, k + int((ids == q_id).sum()))
                    found = found[ids[found] != q_id]
                score = (x[found] * q).sum(axis=1) / (size[found] * q_norm)
                for i in best_of(score, ids[found], k):
                    out.append((q_id, ids[found[i]], score[i]))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = dealt.groupBy("b", "q").cogroup(asks.groupBy("b", "q")).applyInPandas(run, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_multi_index_hashing(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))
