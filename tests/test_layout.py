"""Reading order, fragments and joins of boxes against plain Python."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from quire.operators import layout, spatial

ITEM = "container long, page int, idx int, label string, fixed boolean, l double, t double, r double, b double, style string, owned boolean, text string"


def items(seed):
    g = random.Random(seed)
    out = []
    for c in range(5):
        for i in range(g.choice([1, 12, 40])):
            l, t = g.choice([20, 24, 210, 215, 400]) + g.random(), g.choice([0, 40, 60, 80, 100, 300, 320, 340]) + g.choice([0, 0, 0.5])
            wide = g.random() < 0.1
            box = (20.0, t, 580.0, t + 14) if wide else (l, t, l + g.choice([90, 150, 250]), t + g.choice([8, 14, 19, 60]))
            box = tuple(map(float, box))
            box = g.choice([box] * 9 + [(None,) * 4, (5.0, 5.0, 5.0, 9.0)])
            label = g.choice(["text"] * 6 + ["code"] * 3 + ["page_header", "footnote", "caption", "page_footer"])
            out.append((c, g.choice([1, 1, 2]), i, label, c == 3, *box, g.choice([None] * 5 + ["bold"]), g.random() > 0.1, g.choice([" a ", "b  ", "", "c\n", "dd"])))
    return out


def plain_order(rows):
    """Rows of one container in reading order."""
    if rows[0][4]:
        return sorted(rows, key=lambda r: r[2])
    boxed = [r for r in rows if r[5] is not None and r[5] < r[7] and r[6] < r[8]]
    out = []
    for page in sorted({r[1] for r in boxed}):
        here = [r for r in boxed if r[1] == page]
        seen = [r for r in here if r[3] not in ("page_header", "page_footer", "footnote")]
        gap = statistics.median([max(1.0, r[7] - r[5]) for r in seen] or [1.0]) * 0.6
        cols = []
        for left in sorted(r[5] for r in seen):
            if not cols or left - cols[-1] > gap:
                cols.append(left)
        cols = cols or [0.0]
        near = lambda left: min(range(len(cols)), key=lambda k: abs(cols[k] - left))  # noqa: E731, B023
        reach = {}
        for r in seen:
            top, end = reach.get(near(r[5]), (r[6], r[8]))
            reach[near(r[5])] = min(top, r[6]), max(end, r[8])
        joined = []
        for top, end in sorted(reach.values()):
            if joined and top <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], end)
            else:
                joined.append([top, end])
        side = {"page_header": 0, "page_footer": 2, "footnote": 2}
        out += sorted(here, key=lambda r: (side.get(r[3], 1), sum(e < r[6] for _, e in joined), near(r[5]), r[6], (r[6] + r[8]) / 2, r[5], r[2]))  # noqa: B023
    return out + sorted((r for r in rows if r not in boxed), key=lambda r: r[2])


def plain_chains(rows):
    """(head, ids, text) of one container's rows in reading order, by a fold over the last box of the chain."""
    chains, kept_apart = [], []
    for r in rows:
        c = chains[-1] if chains else None
        if c:
            head, (l, t, rr, b) = c[0], c[1]
            fits = head[3] == r[3] and c[3] == r[1] and None not in (l, r[5])
            if fits and r[4]:
                fits = r[3] == "text" and max(0, min(b, r[8]) - max(t, r[6])) / max(1, min(b - t, r[8] - r[6])) >= 0.7 and rr <= r[5]
            elif fits:
                fits = r[3] in ("text", "code") and max(0, min(rr, r[7]) - max(l, r[5])) / max(1, min(rr - l, r[7] - r[5])) >= 0.7 and -2 <= r[6] - b <= 20
            if fits and head[10] and r[10] and head[9] == r[9]:
                c[1], c[4] = r[5:9], c[4].rstrip() + ("\n" if r[3] == "code" else " ") + r[11].lstrip()
                c[2].append(r[2])
                continue
            if fits:
                kept_apart.append(r[2])
        chains.append([r, r[5:9], [r[2]], r[1], r[11]])
    return [(c[0][2], ",".join(map(str, c[2])), c[4]) for c in chains], kept_apart


@pytest.mark.parametrize("seed", range(4))
def test_reading_order_and_fragments(spark, seed):
    rows = items(seed)
    df = spark.createDataFrame(rows, ITEM).repartition(3)
    ordered = layout.reading_order_of(df)
    marked = layout.fragments(ordered)
    got = {(r.container, r.place): r.idx for r in ordered.collect()}
    chains = sorted((r.container, r.head, r.ids, r.text) for r in layout.chained(marked).collect())
    apart = sorted((r.container, r.idx) for r in marked.where("goes_on AND NOT joined").collect())
    want, want_chains, want_apart = {}, [], []
    for c in {r[0] for r in rows}:
        order = plain_order([r for r in rows if r[0] == c])
        want |= {(c, k): r[2] for k, r in enumerate(order)}
        some, kept = plain_chains(order)
        want_chains += [(c, *x) for x in some]
        want_apart += [(c, x) for x in kept]
    assert got == want
    assert chains == sorted(want_chains) and apart == sorted(want_apart)


def test_crossing_extents_are_one_band(spark):
    title, left, right = (1, 1, 0, "text", False, 20.0, 0.0, 580.0, 20.0, None, True, "t"), [], []
    for k in range(4):
        left.append((1, 1, 10 + k, "text", False, 20.0, 60.0 + 30 * k, 250.0, 80.0 + 30 * k, None, True, "l"))
        right.append((1, 1, 20 + k, "text", False, 310.0, 70.0 + 30 * k, 560.0, 90.0 + 30 * k, None, True, "r"))
    got = sorted((r.place, r.idx) for r in layout.reading_order_of(spark.createDataFrame([*right, *left, title], ITEM)).collect())
    assert [i for _, i in got] == [0, 10, 11, 12, 13, 20, 21, 22, 23]


def boxes(n, seed=1, side=400):
    g = random.Random(seed)
    out = []
    for i in range(n):
        l, t = g.uniform(-50, side), g.uniform(0, side)
        out.append((g.randrange(2), i, l, t, l + g.choice([0.5, 10, 64, 200]), t + g.choice([5, 30, 128])))  # noqa: PERF401
    return [*out, (0, n, 64.0, 64.0, 128.0, 128.0), (0, n + 1, 128.0, 64.0, 192.0, 128.0), (0, n + 2, None, 1.0, 2.0, 3.0)]


def test_joins_by_tiles(spark):
    rows = boxes(300)
    df = spark.createDataFrame(rows, "page int, id int, l double, t double, r double, b double")
    real = [r for r in rows if r[2] is not None]
    pairs = [(p, i, j) for p, i, l, t, r, b in real for q, j, L, T, R, B in real if p == q and i < j and l < R and L < r and t < B and T < b]
    assert sorted(map(tuple, spatial.overlapping(df, ["page"]).collect())) == sorted(pairs)
    large = df.select("page", F.col("id").alias("of"), *[F.col(c).alias(f"{c.upper()}_") for c in "ltrb"])
    inside = [(i, j) for p, i, l, t, r, b in real for q, j, L, T, R, B in real if p == q and L <= l and T <= t and r <= R and b <= B]
    found = spatial.within(df, large, ["page"])
    assert sorted((r.id, r.of) for r in found.select("id", "of").collect()) == sorted(inside)
    middle = spatial.holding(df.select("page", "id", "l", "r"), (F.col("l") + F.col("r")) / 2, large.select("page", "of", "L_", "R_"), "L_", "R_", ["page"])
    assert sorted((r.id, r.of) for r in middle.collect()) == sorted((i, j) for p, i, l, _, r, _ in real for q, j, L, _, R, _ in real if p == q and L <= (l + r) / 2 <= R)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "tx" in plan


def test_a_page_of_many_boxes(spark):
    rows = [(0, i, 70.0 * (i % 200), 70.0 * (i // 200), 70.0 * (i % 200) + 71, 70.0 * (i // 200) + 20.0) for i in range(20_000)]
    df = spark.createDataFrame(rows, "page int, id int, l double, t double, r double, b double")
    assert spatial.overlapping(df, ["page"]).count() == 19_900  # each with its neighbour in the row
