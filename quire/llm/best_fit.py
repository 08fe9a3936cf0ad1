"""Best-fit packing by a plan over lengths (operator 12).

Pieces of one length are alike, so best-fit-decreasing runs over the histogram of lengths, at most one
count for each length up to the capacity, and says for each length which sequences and offsets its
pieces of rank lo to hi take: a plan whose size depends on the capacity alone. Pieces get their rank
within their length in two steps (within the task that tokenised them, and pieces of earlier tasks)
and take their slots by a join with the plan. Ids are never moved for that.

Cases: a null or empty text has only its end id; a document longer than the capacity is cut into full
pieces and a last one, and one row of ids must fit a task's memory; repeated rows and null or equal doc_ids
are packed each; an empty table gives an empty one; other columns are not carried."""

from __future__ import annotations

import struct
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .tokens import encoder, tokenizer_path

LENGTH, END_ID = 2048, 0
#: Rows of ranks before a task (of some 40 bytes) that are broadcast; more are joined by a shuffle.
BASE_ROWS = 500_000
#: Ids that a task gathers before it hands them on.
HAND_ON = 4_000_000
PLAN = "length int, chunk long, lo long, hi long, sequence long, each long, used long"


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, lo, hi, sequence, each, used) of best-fit-decreasing over counts of lengths.

    The pieces of rank lo to hi - 1 of their length fill sequences from `sequence` on, `each` of them in one, from offset `used`.
    A piece goes where the least room is left that takes it; while it fits there again, so does the next."""
    free: dict[int, list[tuple[int, int]]] = {}  # room left: runs of sequences (first, how many)
    rooms: list[int] = []
    plan, fresh = [], 0
    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                first, many = free[room].pop()
                if not free[room]:
                    del free[room], rooms[at]
            else:
                room, first = capacity, fresh
                many = -(-left // (capacity // size))
                fresh += many
            each = min(room // size, left)
            full = min(many, left // each)
            if full < many:  # the rest stays as it was
                free.setdefault(room, []).append((first + full, many - full))
                if len(free[room]) == 1:
                    insort(rooms, room)
            plan.append((size, rank, rank + full * each, first, each, capacity - room))
            rank, left = rank + full * each, left - full * each
            after = room - each * size
            if after:
                free.setdefault(after, []).append((first, full))
                if len(free[after]) == 1:
                    insort(rooms, after)
    return plan


def chunked(plan: list[tuple[int, int, int, int, int, int]]) -> tuple[list[tuple], list[tuple[int, int]]]:
    """The plan's rows under each chunk of ranks that they meet, and the width of a chunk by length: about four chunks for each row."""
    top, rows = {}, {}
    for size, _, hi, *_ in plan:
        top[size], rows[size] = hi, rows.get(size, 0) + 1
    width = {size: max(1, top[size] // (4 * rows[size])) for size in top}
    return [(r[0], c, *r[1:]) for r in plan for c in range(r[1] // width[r[0]], (r[2] - 1) // width[r[0]] + 1)], list(width.items())


def pieces_of(docs: DataFrame, *, length: int, tokenizer: str | None, end_id: int, doc_id: str, text: str) -> DataFrame:
    """(part, doc_id, piece, start, length, local, ids): local is the rank among the task's pieces of this length."""
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        names = ["part", "doc_id", "piece", "start", "length", "local", "ids"]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        enc, end, part = encoder(path), struct.pack("<I", end_id), TaskContext.get().partitionId()
        seen, out, held = np.zeros(length + 1, np.int64), [], 0

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 7, kinds, strict=True)], names)

        for batch in batches:
            for d, t in zip(batch.column(0), batch.column(1), strict=True):
                raw = enc.encode(t.as_py()) + end
                for piece, start in enumerate(range(0, len(raw) // 4, length)):
                    ids = raw[4 * start : 4 * (start + length)]
                    n = len(ids) // 4
                    out.append((part, d.as_py(), piece, start, n, int(seen[n]), ids))
                    seen[n] += 1
                    held += n
                if held >= HAND_ON:
                    yield handed()
                    out, held = [], 0
        yield handed()

    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
    return rows.mapInArrow(run, "part int, doc_id long, piece int, start long, length int, local long, ids binary")


def pack(docs: DataFrame, *, length: int = LENGTH, tokenizer: str | None = None, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", base_rows: int = BASE_ROWS) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset), one row for each piece; ids as little-endian uint32."""
    spark = docs.sparkSession
    laid = written(pieces_of(docs, length=length, tokenizer=tokenizer, end_id=end_id, doc_id=doc_id, text=text), "pieces")
    n = laid.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = written(n.select("part", "length", "n", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before")), "ranks")
    counts = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `length` rows at most
    slots, widths = chunked(best_fit(counts, length))
    plan = spark.createDataFrame(slots, PLAN)
    before = before.join(F.broadcast(spark.createDataFrame(widths, "length int, width long")), "length").select("part", "length", "before", "width")
    ranked = laid.join(F.broadcast(before) if before.count() <= base_rows else before, ["part", "length"]).withColumn("rank", F.col("local") + F.col("before"))
    ranked = ranked.withColumn("chunk", F.floor(F.col("rank") / F.col("width")))
    placed = ranked.join(F.broadcast(plan), ["length", "chunk"]).where("rank >= lo AND rank < hi").withColumn("nth", F.col("rank") - F.col("lo"))
    sequence, offset = F.expr("sequence + nth div each"), F.expr("used + nth % each * length")
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids", sequence.alias("sequence_id"), offset.cast("long").alias("offset"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
