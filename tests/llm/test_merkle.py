"""The Merkle manifest and its proofs against plain Python."""

import hashlib
import random
import string
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from quire.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, text):
    d, _, lang, source, n = row
    return h("".join(map(field, (d, source, lang, n, text))))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def brute(rows):
    """Rows as the query returns them."""
    keyed = sorted(rows, key=lambda r: ((r[3] is not None, (r[3] or "").encode()), (r[0] is not None, r[0] or 0), leaf(r, r[1])))
    trees = [list(g) for _, g in groupby(keyed, key=lambda r: r[3])]
    built = [levels([leaf(r, r[1]) for r in t]) for t in trees]
    top = levels([b[-1][0] for b in built])
    out = []
    for rank, (t, b) in enumerate(zip(trees, built, strict=True)):
        for i, r in enumerate(t):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None
            fold, proof = leaf(r, r[1].translate(LOWER) if bad else r[1]), ""
            for place, tree in ((i, b), (rank, top)):
                for level in tree[:-1]:
                    lo = place // 16 * 16
                    left, right = "".join(level[lo:place]), "".join(level[place + 1 : lo + 16])
                    proof, fold, place = proof + left + right, h(left + fold + right), place // 16
            out.append((r[0], b[0][i], b[-1][0], top[-1][0], h(proof), fold, fold == top[-1][0]))
    return out


def found(rows, spark, parts=3, **args):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    for c in ("leaf", "part", "k", "m", "hash", "w", "at", "tree", "pos", "root", "proof"):
        docs = docs.withColumn(c, F.lit("mine"))
    out = merkle.proofs(merkle.build(merkle.leaves_of(docs)), **args)
    hx = lambda c: F.lower(F.hex(c))
    return [tuple(r) for r in out.select("doc_id", hx("leaf"), hx("subroot"), hx("root"), F.sha2(hx("proof"), 256), hx("folded_root"), F.col("folded_root") == F.col("root")).collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v if v is not None else 0) for v in r))


def many():
    g = random.Random(5)
    rows = [(i, f"Text {i} " + "Ünïcode " * g.randrange(4), "en", "hot", i % 7) for i in range(700)]
    rows += [(1000 + i, None if i % 9 == 0 else "Some TEXT" if i % 2 else "plain", None, g.choice(["a", "b", None, "Z", "é"]), None) for i in range(90)]
    rows += [(2000 + i, "x", "de", f"s{i:03d}", 1) for i in range(300)] + [(None, "No id", "en", "hot", 1)] * 2
    return rows + [(7, "again", "en", "hot", 3), (7, "again", "en", "hot", 3), (8, "", "", "", 0), (9, "long " * 60_000, "en", "hot", 9)]


@pytest.mark.parametrize("top", [20_000, 6, 1])
def test_proofs_equal_plain_python(spark, top):
    rows = many()
    assert ordered(found(rows, spark, top_nodes=top)) == ordered(brute(rows))


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 257])
@pytest.mark.parametrize("sources", [1, 2])
def test_sizes_of_trees(spark, n, sources):
    rows = [(i, f"T{i}", "en", f"s{i % sources}", 1) for i in range(n)]
    assert ordered(found(rows, spark, parts=1)) == ordered(brute(rows)) if n else found(rows, spark) == []


def test_tampering_is_seen(spark):
    got = {r[0]: r[-1] for r in found([(i, f"Text {i}" if i % 2 else f"text {i}", "en", "a", 1) for i in range(60)], spark)}
    assert got == {i: not (zlib.crc32(str(i).encode()) % 5 == 0 and i % 2) for i in range(60)}
