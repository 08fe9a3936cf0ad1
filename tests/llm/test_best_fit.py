"""Best-fit packing against one-by-one best fit, and its round trip against the tokenizer."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import best_fit
from quire.llm.tokens import tokenizer_path

SCHEMA = "doc_id long, text string, source string"
BASE = "the quick brown fox jumps over the lazy dog and then it sleeps "
ROWS = [(i, BASE * (i % 7) + "word " * (i % 5), "a") for i in range(150)] + [(200, None, None), (201, "", "b"), (None, "no id", "b"), (203, BASE * 900, "c")] + [(204, "twice the same", "c")] * 2


def one_by_one(sizes, capacity):
    """The room left in each sequence by best-fit-decreasing."""
    rooms = []
    for size in sorted(sizes, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= size]
        if fits:
            rooms[min(fits)[1]] -= size
        else:
            rooms.append(capacity - size)
    return rooms


@pytest.mark.parametrize("seed", range(12))
def test_plan_equals_best_fit_one_by_one(seed):
    g = random.Random(seed)
    capacity = g.choice([7, 20, 64])
    sizes = [g.randint(1, g.choice([capacity, capacity // 2 + 1])) for _ in range(g.choice([1, 30, 400]))]
    counts = Counter(sizes)
    plan = best_fit.best_fit(counts, capacity)
    filled, ranks = {}, Counter()
    for size, lo, hi, first, each, used in plan:
        assert lo == ranks[size] and hi > lo and (hi - lo) % each == 0
        ranks[size] = hi
        for k in range(hi - lo):
            filled.setdefault(first + k // each, []).append((used + k % each * size, size))
    assert ranks == counts
    for parts in filled.values():
        at = 0
        for off, size in sorted(parts):
            assert off == at
            at += size
        assert at <= capacity
    assert sorted(capacity - sum(s for _, s in p) for p in filled.values()) == sorted(one_by_one(sizes, capacity))


def test_plan_is_small():
    g = random.Random(1)
    counts = {s: g.randrange(1, 10**9) for s in range(1, 2049)}
    plan = best_fit.best_fit(counts, 2048)
    slots, widths = best_fit.chunked(plan)
    assert len(plan) < 30_000 and len(slots) < 6 * len(plan) and len(widths) == 2048
    assert max(r[3] for r in plan) < 1.01 * sum(s * n for s, n in counts.items()) / 2048


@pytest.mark.parametrize("base_rows", [0, 10_000])
def test_round_trip(spark, base_rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(4)
    for c in ("part", "piece", "length", "ids", "rank", "lo", "n", "before", "d", "t"):
        docs = docs.withColumn(c, F.lit("mine"))
    got = best_fit.pack(docs, length=64, base_rows=base_rows).collect()
    want = Counter()
    for d, t, _ in ROWS:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        want.update((d, k, at, tuple(ids[at : at + 64])) for k, at in enumerate(range(0, len(ids), 64)))
    assert Counter((r.doc_id, r.piece, r.start, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    rooms = one_by_one([len(x[3]) for x in want.elements()], 64)
    filled = {}
    for r in got:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for off, size in sorted(parts):
            assert off == at
            at += size
        assert at <= 64
    assert len(filled) == len(rooms)


def test_empty_table(spark):
    assert best_fit.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_on_given_tables(spark):
    got = best_fit.op12_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    sizes = [r.length for r in got]
    assert len({r.doc_id for r in got}) == 200
    assert len({r.sequence_id for r in got}) == len(one_by_one(sizes, 2048))
