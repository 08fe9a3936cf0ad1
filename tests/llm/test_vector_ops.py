"""Operators on vectors against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import multi_index, pivots

SCHEMA = "vec_id long, embedding array<float>, label int, n int, vector string"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(260, 16)).astype(np.float32)
    near = [x[i] + rng.normal(size=16).astype(np.float32) * 0.12 for i in range(30) for _ in range(3)]
    hot = [x[0] + rng.normal(size=16).astype(np.float32) * 0.05 for _ in range(80)]
    all_ = [*x, *near, *hot, x[5], x[5], 2 * x[6]]
    out = [(i, v.tolist(), i % 3, 1, "c") for i, v in enumerate(all_)]
    bad = [None, [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15]
    return out + [(1000 + i, v, 0, 1, "c") for i, v in enumerate(bad)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def cosines(rows):
    x = np.array([r[1] for r in rows if r[0] < 1000], np.float32).astype(float)
    return (x @ x.T) / np.sqrt(np.outer((x * x).sum(1), (x * x).sum(1)))


@pytest.mark.parametrize("chunk", [2048, 40])
def test_links_and_components(spark, table, rows, chunk):
    c = cosines(rows)
    want = c >= 0.9
    np.fill_diagonal(want, False)
    comp = np.arange(len(c))
    for _ in range(20):
        comp = np.minimum(comp, np.where(want, comp[None, :], len(c)).min(axis=1))
    got = {r.vec_id: r for r in pivots.links(table, chunk=chunk).collect()}
    assert len(got) == len(rows)
    for i in range(1000, 1005):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    found = sum(got[i].n_links for i in range(len(c)))
    assert found <= want.sum() and found >= 0.97 * want.sum()
    assert all(got[i].n_links <= want[i].sum() for i in range(len(c)))
    assert np.mean([got[i].component_id == comp[i] for i in range(len(c))]) > 0.97
    assert all(got[i].kept == (got[i].component_id == i) for i in range(len(c)))


def test_all_pivots_shared_finds_every_link(spark, table, rows):
    c = cosines(rows)
    want = (c >= 0.9).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in pivots.links(table, prefix=64, shared=1).collect()}
    assert [got[i] for i in range(len(c))] == want.tolist()


def neighbours_found(c, got, every):
    """The share of each query's 5 nearest that is found; ranks, scores and order are checked."""
    by = {}
    for r in sorted(got, key=lambda r: r.rank):
        by.setdefault(r.query_id, []).append(r)
    assert sorted(by) == [i for i in range(len(c)) if i % every == 0]
    met = 0
    for q, found in by.items():
        s = c[q].copy()
        s[q] = -9
        assert [r.rank for r in found] == [1, 2, 3, 4, 5]
        assert np.allclose([r.score for r in found], s[[r.vec_id for r in found]], atol=1e-9)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        met += len({r.vec_id for r in found} & set(np.lexsort((np.arange(len(c)), -s.round(12)))[:5].tolist()))
    return met / 5 / len(by)


def test_neighbours(spark, table, rows):
    c = cosines(rows)
    asked = table.where("vec_id % 10 = 0")
    assert neighbours_found(c, multi_index.nearest(table, asked, 5, recall=1.0, turns=1, block=50, query_block=3).collect(), 10) > 0.97
    assert neighbours_found(c, multi_index.nearest(table, asked, 5).collect(), 10) > 0.9


@pytest.mark.parametrize("groups", [0, 40])
def test_neighbours_in_a_larger_table(spark, groups):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3000, 32))
    if groups:
        x[:2000] = rng.normal(size=(groups, 32))[rng.integers(0, groups, 2000)] + 0.3 * x[:2000]
    x = x.astype(np.float32)
    rows = [(i, v.tolist(), 0, 1, "c") for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, SCHEMA)
    y = x.astype(float)
    c = (y @ y.T) / np.sqrt(np.outer((y * y).sum(1), (y * y).sum(1)))
    recall = neighbours_found(c, multi_index.nearest(vectors, vectors.where("vec_id % 50 = 0")).collect(), 50)
    print("recall", groups, recall)
    assert recall >= 0.9


def test_index_retrieves_every_code_in_radius():
    rng = np.random.default_rng(1)
    code = rng.integers(0, 2**63, (500, 2)).astype(np.uint64) & np.uint64(2**24 - 1)
    code[100:200] = code[:100] ^ np.uint64(5)
    for m in (2, 4, 6):
        index = multi_index.BlockIndex(code, 24, m)
        for q in code[:20]:
            for r in (0, 3, 7, 16):
                assert index.within(q, r).tolist() == np.flatnonzero(multi_index.apart(code, q) <= r).tolist()


def test_few_rows(spark, table):
    empty = table.limit(0)
    assert pivots.links(empty).count() == 0 and multi_index.nearest(empty, empty).count() == 0
    one = table.where("vec_id = 1")
    assert multi_index.nearest(one, one).count() == 0
    two = table.where("vec_id in (1, 2, 1000)").union(one)
    assert [(r.query_id, r.vec_id) for r in multi_index.nearest(two, one).collect()] == [(1, 2)]
    got = pivots.links(two).orderBy("vec_id").select("vec_id", "n_links", "component_id").collect()
    assert [tuple(r) for r in got] == [(1, 1, 1), (1, 1, 1), (2, 0, 2), (1000, 0, 1000)]
    assert pivots.links(table.withColumn("vec_id", F.lit(None).cast("long"))).where("kept").count() == 0


@pytest.mark.parametrize("kind", ["one cluster", "common direction", "six pivots", "scaled", "two near"])
def test_links_where_few_pivots_are_kept(spark, kind):
    rng = np.random.default_rng(7)
    v = rng.normal(size=16)
    if kind == "one cluster":
        x = [v + 0.3 * rng.normal(size=16) for _ in range(150)]
    elif kind == "common direction":
        x = [5 * v / np.linalg.norm(v) + rng.normal(size=16) * rng.choice([0.2, 0.5, 0.9]) for _ in range(150)]
    elif kind == "six pivots":
        x = [1.8 * v / np.linalg.norm(v) + 0.3 * c + 0.25 * rng.normal(size=16) for c in rng.normal(size=(12, 16)) for _ in range(15)]
    else:
        x = [v, 2 * v] if kind == "scaled" else [v, v + 0.2 * rng.normal(size=16)]
    rows = [(i, y.astype(np.float32).tolist(), 0, 1, "c") for i, y in enumerate(x)]
    want = cosines(rows) >= 0.9
    got = {r.vec_id: r.n_links for r in pivots.links(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i] for i in range(len(rows))] == (want.sum(axis=1) - 1).tolist() and want.sum() > len(rows)
