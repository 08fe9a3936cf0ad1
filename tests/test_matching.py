"""Late interaction, neighbours' evidence and the selection fold against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import matching, structures
from quire.sources.files import unsettled


def vectors(seed=1, units=60):
    """(unit, span, vector): unequal numbers of spans, groups of like units, one unit without its first span."""
    g = np.random.default_rng(seed)
    base = g.normal(size=(12, 8))
    out = []
    for u in range(units):
        for s in range(int(g.integers(1, 6))):
            if (u, s) != (7, 0):
                v = base[(u // 3 + s) % 12] + g.normal(size=8) * 0.4
                out.append((u, s, (v / np.linalg.norm(v)).tolist()))
    return out


@pytest.mark.parametrize("block", [65_536, 5])
def test_late_interaction(spark, monkeypatch, block):
    monkeypatch.setattr(structures, "ROW_BLOCK", block)
    monkeypatch.setattr(structures, "QUERY_BLOCK", 3 * block)
    rows = vectors()
    df = spark.createDataFrame(rows, "unit long, span int, u array<double>")
    got = {(r.query, r.unit): (r.cosine, r.coverage, r.score) for r in matching.late_interaction(df.where("unit % 4 = 0"), df).collect()}
    by = {}
    for u, s, v in rows:
        by.setdefault(u, {})[s] = np.array(v)
    want = {}
    for q in range(0, 60, 4):
        all_ = []
        for u in set(by) - {q}:
            coverage = round(float(np.mean([max(float(a @ b) for b in by[u].values()) for a in by[q].values()])), 5)
            cosine = round(float(by[q][0] @ by[u][0]), 5) if 0 in by[u] and 0 in by[q] else -1.0
            all_.append((-max(cosine, coverage), u, cosine, coverage))
        want |= {(q, u): (cosine, coverage, -s) for s, u, cosine, coverage in sorted(all_)[: matching.KEPT]}
    assert got.keys() == want.keys()
    assert all(abs(x - y) < 2e-5 for k in want for x, y in zip(got[k], want[k], strict=True))


def test_neighbours(spark):
    rows = [(u // 10, u % 10, u, v) for u, s, v in vectors(3) if s == 0]
    texts = spark.createDataFrame(rows, "doc long, ord long, unit long, u array<double>")
    u = {r[2]: np.array(r[3]) for r in rows}
    pool = [(q, c, round(float(u[q] @ u[c]), 5)) for q in u for c in u if q != c and (q + c) % 3 == 0]
    got = {(r.query, r.unit): (r.neighbours, r.score) for r in matching.with_neighbours(spark.createDataFrame(pool, "query long, unit long, cosine double"), texts).collect()}
    assert len(got) == len(pool)
    for q, c, own in pool:
        near = [round(float(u[n] @ u[c]), 5) for n in u if n != q and n // 10 == q // 10 and abs(n - q) <= 3]
        near = [x for x in near if x >= 0.69]
        want = max(own, (own + sum(near)) / (1 + len(near))) if near else own
        assert got[q, c][0] == len(near) and abs(got[q, c][1] - want) < 2e-5
    assert any(n for n, _ in got.values())


@pytest.mark.parametrize("cap", [32, 6, 1])
def test_selection_is_the_fold(spark, cap):
    g = random.Random(cap)
    asked = [(r, n, "source", g.randrange(1000, 1004)) for r in range(6) for n in range(g.randrange(1, 4))]
    ranked = [(r, n, "target", g.randrange(20), k) for r, n, *_ in asked for k in range(1, g.randrange(1, 4))]
    near = [(r, n, side, step, ("source", "target")[side], g.randrange(20)) for r, n, *_ in asked for side in (0, 1) for step in range(1, g.randrange(1, 7))]
    frames = [spark.createDataFrame(rows, s) for rows, s in ((ranked, "request long, nth long, role string, id long, k int"), (near, "request long, nth long, side int, step int, role string, id long"), (asked, "request long, nth long, role string, id long"))]
    got = sorted(map(tuple, matching.selection(*frames, cap).select("request", "place", "role", "id").collect()))
    want = []
    for r in range(6):
        taken = []

        def add(role, one):
            if (role, one) not in taken and len(taken) < cap:  # noqa: B023
                taken.append((role, one))  # noqa: B023

        for rows, key in ((asked, lambda x: x[1]), (ranked, lambda x: (x[1], x[4])), (near, lambda x: x[1:4])):
            for x in sorted((x for x in rows if x[0] == r), key=key):
                add(*((x[2], x[3]) if rows is not near else (x[4], x[5])))
        want += [(r, i, *x) for i, x in enumerate(taken, 1)]
    assert got == sorted(want)


def test_near_pairs_follow_the_files(spark, tmp_path):
    """The saved search is that of the table as it stands."""
    rows = [(i, np.eye(4)[i % 4].tolist(), 0) for i in range(60)]
    at = f"file://{tmp_path}"
    write = lambda data: spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").coalesce(1).write.mode("overwrite").parquet(f"{at}/embeddings.parquet")
    write(rows)
    first = structures.near_pairs(spark, at)
    assert structures.near_pairs(spark, at) is first and first.where(F.col("query_id") == 0).count() == 20
    write(rows[:30])
    assert structures.near_pairs(spark, at).where("vec_id >= 30").count() == 0


def test_near_pairs_outlast_their_files(spark, tmp_path):
    """Where the shared folder was cleared between two queries, the search is written anew."""
    at = f"file://{tmp_path}"
    spark.createDataFrame([(i, np.eye(4)[i % 4].tolist(), 0) for i in range(60)], "vec_id long, embedding array<double>, label int").write.parquet(f"{at}/embeddings.parquet")
    first = structures.near_pairs(spark, at)
    want = sorted(map(tuple, first.collect()))
    unsettled(first)
    assert sorted(map(tuple, structures.near_pairs(spark, at).collect())) == want
    unsettled(structures._FOUND[next(k for k in structures._FOUND if k[1] == at)])
    assert sorted(r["vec_id"] for r in structures.vector_topk(spark, at).where("query_id = 0").collect()) == [4, 8, 12, 16, 20]


def test_near_pairs_by_tiles_are_those_of_brute_force(spark, tmp_path, monkeypatch):
    """Blocks and tiles of a few vectors: copies tie by id, a component that isn't a number comes first as in SQL, a vector without a length takes no part."""
    for name, value in (("TILED_QUERIES", 3), ("TILED_ROWS", 70), ("TILE", 2)):
        monkeypatch.setattr(structures, name, value)
    x = np.random.default_rng(5).normal(size=(400, 6)).round(2)
    x[100:200] = x[50]
    x[7], x[8] = 0, np.nan
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    want = []
    for q in range(0, 400, 50):
        cosine = {i: round(float(x[q] @ v / np.sqrt((x[q] @ x[q]) * (v @ v))), 5) for i, v in enumerate(x) if i not in (q, 7)}
        want += [(q, i) for i in sorted(cosine, key=lambda i: (0 if np.isnan(cosine[i]) else 1, -cosine[i] if i != 8 else 0, i))[:20]]  # noqa: B023
    assert sorted((r["query_id"], r["vec_id"]) for r in structures.near_pairs(spark, str(tmp_path)).collect()) == sorted(want)


def test_near_pairs_of_many_files(spark, tmp_path):
    """The state of a table of many files is known without a sum of their hashes, which overflows."""
    df = spark.createDataFrame([(i, np.eye(4)[i % 4].tolist(), 0) for i in range(640)], "vec_id long, embedding array<double>, label int")
    df.repartition(64).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert structures.near_pairs(spark, str(tmp_path)).where("query_id = 0 AND vec_id % 4 = 0").count() == 20
