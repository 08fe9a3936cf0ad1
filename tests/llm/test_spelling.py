"""Spelling variants against comparison of all words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.llm import spelling

SCHEMA = "doc_id long, text string, source string"
UPPER = {c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def counted(rows, lose=199, shortest=6, fewest=5):
    n = Counter()
    for d, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(UPPER.get(c, c) for c in run)
            h = zlib.crc32(f"{d}:{run}".encode())
            if d is not None and h % lose == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= shortest and k >= fewest}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(rows, **args):
    n = counted(rows, **args)
    near = {w: [] for w in n}
    holes = {}
    for w in n:  # words of one edit share a word with a hole, or one is the other's hole
        for i in range(len(w)):
            holes.setdefault(w[:i] + w[i + 1 :], []).append(w)
    for w in n:
        close = {v for i in range(len(w)) for v in holes[w[:i] + w[i + 1 :]]} | set(holes.get(w, [])) | {w[:i] + w[i + 1 :] for i in range(len(w))}
        near[w] = sorted(v for v in close if v in n and one_edit(w, v))
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out, key=str)


def found(df, **args):
    return sorted(map(tuple, spelling.variants(df, **args).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def rows():
    g = random.Random(9)
    stems = ["".join(g.choice("abcdeéß") for _ in range(g.randint(6, 11))) for _ in range(60)] + ["aaaaaaaa", "abababab"]
    words = []
    for s in stems:
        words += [s] * g.choice([5, 30, 200, 1000])
        for _ in range(12):
            w, i = list(s), g.randrange(len(s))
            kind = g.randrange(3)
            w[i : i + (kind != 0)] = [g.choice("abcdeé")] * (kind != 2)
            words += ["".join(w)] * g.choice([2, 5, 6, 40])
    g.shuffle(words)
    out = [(i, " ".join(w.upper() if k % 5 == 0 and w.isascii() else w for k, w in enumerate(words[i::97])), "a") for i in range(97)]
    return out + [(100, None, None), (101, "", "b"), (None, "nobody nobody nobody nobody nobody", "b"), (103, "straße_straße-straße;STRASSE×÷ " * 9000, "c")] + [(104, "repeat repeats repeat", "c")] * 6


@pytest.mark.parametrize("lose", [199, 3])
def test_variants_equal_all_pairs(spark, lose):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    for c in ("word", "n", "run", "h", "gram", "size", "d", "root"):
        df = df.withColumn(c, F.lit("mine"))
    want = brute(data, lose=lose)
    assert found(df, lose=lose) == want and any(r[1] and r[2] != r[1] for r in want)


def test_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute(list(map(tuple, docs.select("doc_id", "text").collect())))
    got = spelling.op13_spelling_variants(spark, "/root/testdata/sf0.01")
    assert sorted(map(tuple, got.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str) == want


def test_empty_table(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_pivots_are_disjoint_and_rarest():
    g = random.Random(2)
    for _ in range(300):
        places = [(i, k, g.randint(1, 9)) for k, i in enumerate(g.sample(range(12), g.randint(3, 7)))]
        got = spelling.pivots_of(places)
        want = min(a[2] + b[2] for a in places for b in places if b[0] >= a[0] + 2)
        assert sum(p[2] for p in got) == want and got[1][0] >= got[0][0] + 2
