"""Packing documents into sequences along a space-filling curve (operator 9).

A document's ids, hashed into counts, make a vector; a fixed random projection takes it to three
dimensions, and its Hilbert key orders documents so that neighbours on the curve have like words.
Documents are range-sorted by key and laid end to end; sequence s holds positions s * LENGTH to
(s + 1) * LENGTH, so only the last sequence can need padding. Tokenised rows are written once and
range-sorted once; where a partition starts is known from the totals of those before it.

Cases: a null or empty text has only its end id; a document longer than a sequence is cut into
pieces, and one row of ids must fit a task's memory; rows with the same key are ordered by doc_id and text hash; repeated rows are packed each;
an empty table gives an empty one; other columns are not carried."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_objects, dropped, offsets, partitions_for, table, written
from .tokens import encoder, tokenizer_path

LENGTH, END_ID = 4096, 2
WIDTH, DIMS, BITS, SEED = 4096, 3, 16, 20240229


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of integer points (n, dims), each coordinate under 2 ** bits (bits * dims <= 62).

    By Skilling's transform: undo the excess work of each bit from the top, Gray-encode, interleave."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        q, low = np.int64(1 << b), np.int64((1 << b) - 1)
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> b) & 1, np.int64((1 << b) - 1), 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_points(ids: list[np.ndarray], projection: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Projected square-rooted counts of hashed ids; tanh spreads them over the grid."""
    out = np.zeros((len(ids), projection.shape[1]))
    for k, one in enumerate(ids):
        if len(one):
            at, n = np.unique(one.astype(np.int64) * 2654435761 % (1 << 32) >> 20, return_counts=True)
            v = np.sqrt(n)
            out[k] = v @ projection[at] / np.sqrt(n.sum())
    return np.minimum(((np.tanh(out) + 1) / 2 * (1 << bits)).astype(np.int64), (1 << bits) - 1)


def tokenised(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, curve, tie, n, ids): ids as little-endian uint16 where they fit, else uint32."""
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        enc, end = encoder(path), struct.pack("<I", end_id)
        g = np.random.default_rng(SEED).normal(size=(WIDTH, DIMS))
        for pdf in batches:
            ids = [np.frombuffer(enc.encode(t if isinstance(t, str) else "") + end, "<u4") for t in pdf["t"].array]
            key = hilbert(curve_points(ids, g))
            yield pd.DataFrame({"d": pdf["d"].astype(object), "tie": pdf["tie"], "curve": key, "n": [len(x) for x in ids], "ids": [(x.astype("<u2") if int(x.max()) < 1 << 16 else x).tobytes() for x in ids]})

    rows = docs.select(F.col(doc_id).cast("string").alias("d"), F.xxhash64(text).alias("tie"), F.col(text).alias("t"))
    out = rows.mapInPandas(run, "d string, tie long, curve long, n long, ids binary")
    return out.select(F.col("d").cast("long").alias("doc_id"), "curve", "tie", "n", "ids")


def pack(docs: DataFrame, *, length: int = LENGTH, tokenizer: str | None = None, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset), one row for each piece.

    ids: the piece's ids as little-endian uint32."""
    spark = docs.sparkSession
    rows = written(tokenised(docs, tokenizer=tokenizer, end_id=end_id, doc_id=doc_id, text=text), "tokenised")

    def running(batches: Iterator) -> Iterator:
        at = 0
        for pdf in batches:
            upto = at + pdf["n"].cumsum()
            pdf["local"] = upto - pdf["n"]
            at = int(upto.iloc[-1]) if len(upto) else at
            yield as_objects(pdf)

    size = 2 * (rows.agg(F.sum("n")).first()[0] or 0)  # two bytes for most ids
    ranged = rows.repartitionByRange(partitions_for(spark, size), "curve", "doc_id", "tie").sortWithinPartitions("curve", "doc_id", "tie")
    # doc_id as text: a column of integers and nulls would turn into floats
    ranged = ranged.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("string").alias("doc_id"), "n", "ids")
    laid = written(ranged.mapInPandas(running, "part int, doc_id string, n long, ids binary, local long"), "laid")
    dropped(rows)
    before = offsets(laid.groupBy("part").agg(F.sum("n").alias("n")), "part", "n")  # a row for each shuffle partition

    def cut(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            out = []
            for d, n, raw, at in zip(pdf["doc_id"], pdf["n"], pdf["ids"], pdf["at"], strict=True):
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                start = 0
                while start < n:
                    seq, off = divmod(at + start, length)
                    size = min(n - start, length - off)
                    out.append((d, start, size, ids[start : start + size].tobytes(), n, seq, off))
                    start += size
            yield as_objects(pd.DataFrame(out, columns=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]))

    placed = laid.join(F.broadcast(before), "part").select("doc_id", "n", "ids", (F.col("local") + F.col("before")).alias("at"))
    pieces = placed.mapInPandas(cut, "doc_id string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return pieces.withColumn("doc_id", F.col("doc_id").cast("long"))


def sequences(pieces: DataFrame, *, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n_ids, ids): pieces put together, as little-endian uint32.

    Padded to `length` with pad_id, but for a sequence whose own length is a power of two."""

    whole = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    n = F.col("n_ids")
    pad = F.when(n.bitwiseAND(n - 1) == 0, 0).otherwise(F.lit(length) - n).cast("int")
    filler = F.unhex(F.repeat(F.lit(struct.pack("<I", pad_id).hex()), pad))
    return whole.select("sequence_id", "n_ids", F.concat(ids, filler).alias("ids"))


def op9_hilbert_packing(spark, sf_dir):
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
