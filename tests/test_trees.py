"""Pointer jumping, sizes and walks against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import trees


def forest(seed, n, loops=0, base=0):
    g = random.Random(seed)
    up = {base + i: base + g.randrange(i) if i and g.random() < 0.97 else None for i in range(n)}
    for k in range(loops):  # a circle of three, and a tail below it
        a = base + n + 10 * k
        up |= {a: a + 2, a + 1: a, a + 2: a + 1, a + 3: a, a + 4: a + 3}
    return up


def chain_up(up, v):
    out, seen = [], set()
    while up[v] is not None:
        v = up[v]
        if v in seen:
            return None
        seen.add(v)
        out.append(v)
    return out


@pytest.mark.parametrize(("seed", "n", "loops", "base"), [(1, 400, 2, 0), (2, 1, 0, 5), (3, 60, 1, 9_999_990)])
def test_climb(spark, seed, n, loops, base):
    up = forest(seed, n, loops, base)
    e = spark.createDataFrame(list(up.items()), "child long, parent long").repartition(3)
    marked, worth = F.col("child") % 7 == 0, F.when(F.col("child") % 3 == 0, F.col("child"))
    got = trees.climb(e, {"marked": (marked, "any"), "n": (F.col("child") % 5, "sum"), "near": (worth, "nearest")}).collect()
    assert sorted(r.child for r in got) == sorted(v for v in up if up[v] is not None)
    for r in got:
        path = chain_up(up, r.child)
        if path is None:
            assert (r.root, r.marked, r.n, r.near) == (None, None, None, None)
        else:
            assert (r.root, r.marked, r.n) == (path[-1], any(v % 7 == 0 for v in path), sum(v % 5 for v in path))
            assert r.near == next((v for v in path if v % 3 == 0), None)


def plain_walk(up, roots):
    below, out = {}, []
    for v in sorted(up):
        below.setdefault(up[v], []).append(v)
    todo = list(reversed(roots))
    while todo:
        v = todo.pop()
        out.append(v)
        todo += reversed(below.get(v, []))
    return out


def test_sizes_and_preorder(spark):
    up = forest(4, 500)
    e = spark.createDataFrame(list(up.items()), "child long, parent long").repartition(3)
    order = plain_walk(up, sorted(v for v in up if up[v] is None))
    got = sorted(trees.preorder(e, []).collect(), key=lambda r: r.place)
    assert [r.child for r in got] == order and [r.place for r in got] == list(range(500))
    size = dict(trees.sizes(e).collect())
    assert size == {v: 1 + sum(v in (chain_up(up, u) or []) for u in up) for v in up}


def test_walk_takes_what_is_left(spark):
    up = forest(6, 300, loops=2, base=999_900)
    e = spark.createDataFrame(list(up.items()), "child long, parent long").repartition(3)
    body = next(v for v in up if up[v] is None)
    got = sorted(trees.walk(e, F.col("child") == body, F.col("child") % 3).collect(), key=lambda r: r.place)
    reached = plain_walk(up, [body])
    assert [r.child for r in got if r.reached] == reached
    assert [r.child for r in got if not r.reached] == sorted(set(up) - set(reached), key=lambda v: (v % 3, v)) and [r.place for r in got] == list(range(len(up)))


def test_long_chain(spark):
    e = spark.range(100_000).select(F.col("id").alias("child"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    got = trees.climb(e, {"n": (F.lit(1).cast("long"), "sum")})
    assert got.where("n <> child OR root <> 0").count() == 0 and got.count() == 99_999


def test_empty(spark):
    e = spark.createDataFrame([], "child long, parent long")
    assert trees.climb(e, {}).count() == trees.sizes(e).count() == trees.preorder(e, []).count() == 0


def test_picture_descendants_are_all_texts_under_a_picture(spark, tmp_path):
    spark.range(1, 400).select(F.col("id").alias("o_orderkey")).write.parquet(str(tmp_path / "orders.parquet"))
    label = {k: "picture" if k % 5 == 0 else "list" if k % 3 == 0 else "text" for k in range(400)}
    up = {k: (k // 3 + (k < 3) if k > 1 else None) for k in range(1, 400)}
    want = [v for v in up if label[v] == "text" and any(label[a] == "picture" for a in chain_up(up, v))]
    assert any(v % 7 == 0 for v in want)
    assert sorted(r.child for r in trees.picture_descendants(spark, str(tmp_path)).collect()) == want
