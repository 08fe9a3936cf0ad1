"""Operators without SQL against plain Python."""

import difflib
import os
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import rules as R
from quire.functions import text as T
from quire.operators import aggregates, structures, validation
from quire.plans import registry
from quire.sources import views as V

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. !?\n。A", max_size=400))
def test_sentences_are_lossless(s):
    assert "".join(T.sentences_of(s)) == s


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc .\nX", max_size=900), st.integers(30, 120))
def test_chunks_fit_and_cover(s, limit):
    chunks = T.chunks_of(s, limit, 10)
    assert all(0 < len(c) <= limit and c == c.strip() for c in chunks)
    assert all(w in "".join(chunks) or any(w[:20] in c for c in chunks) for w in s.split() if len(w) < 10)


@pytest.mark.parametrize(("sizes", "budget", "most", "want"), [([1, 2, 3], 3, 9, [0, 0, 1]), ([9, 1, 1], 3, 9, [0, 1, 1]), ([1, 1, 1], 9, 2, [0, 0, 1]), ([], 3, 3, [])])
def test_packed(spark, sizes, budget, most, want):
    df = spark.createDataFrame([([(i, n) for i, n in enumerate(sizes)],)], "u array<struct<ord:int,n:int>>")
    got = df.select(structures.packed(F.col("u"), lambda x: x["n"], budget, most).alias("b")).first().b
    assert [x.batch for x in got] == want


def test_anchors_compare_with_the_last_anchor(spark):
    df = spark.createDataFrame([([0.0, 4.0, 8.0, 30.0, 33.0],)], "v array<double>")
    assert df.select(aggregates.anchors_of(F.col("v"), 6.0).alias("a")).first().a == [0.0, 8.0, 30.0]


def test_matching_places():
    a, b = list("abcdxyz"), list("bcdaxz")
    assert all(a[i] == b[j] for i, j in structures.matching_places(a, b))
    assert len(structures.matching_places(a, b)) == sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def test_chunks_by_rule():
    text = "Aa bb.\r\n\r\nCc dd.\rEe.\n\n" + "x" * 25 + " " + "y" * 9 + "\n\nLast. One."
    assert T.chunks_of(text, 20, 8)[:2] == ["Aa bb.\n\nCc dd.\nEe.", "x" * 20]
    assert all(len(c) <= 20 for c in T.chunks_of(text, 20, 8)) and "\r" not in "".join(T.chunks_of(text, 20, 8))
    assert T.chunks_of("one\n\ntwo\n\nthree\n\nfour", 12, 6) == ["one\n\ntwo", "two\n\nthree", "four"]
    assert T.chunks_of(None) == T.chunks_of(" \n") == []


def value(spark, column, **fields):
    names = list(fields)
    df = spark.createDataFrame([tuple(fields.values())], ", ".join(f"{n} string" for n in names))
    return df.select(column(*[F.col(n) for n in names]).alias("x")).first().x


@pytest.mark.parametrize(
    ("rule", "cases"),
    [
        (R.table_value, {"7,43 4": "7,434", "1,79\n6": "1,796", "12 34": "12 34", "1,234 567": "1,234 567", "Budget 2005": "Budget 2005"}),
        (R.row_label, {"Page _ 05": "page_05", "A - b 7": "a-b7"}),
        (R.page_ref, {"V-1 2": "V-1 2", "V-12": "V-1 2", "III-1 0": "III-1 0", "III-10": "III-1 0", "1 2": None, "12": None}),
        (R.heading_depth, {"1.2.3 Title": 3, "4) x": 1, "Title": None, "1.2Title": None}),
        (R.date_value, {"2024-02-29": "2024-02-29", "2024/0230": None, "2024 . 12 . 01": "2024-12-01", "20241201": None}),
        (R.unfenced, {' ```json\n{"a": 1}\n``` ': '{"a": 1}', "```json```": "", "{}": "{}", "```json``": "```json``"}),
        (R.markdown_escaped, {"a*b_[c]": "a\\*b\\_\\[c\\]"}),
        (R.fence, {"a ```` b ` c": "`" * 5, "none": "```"}),
        (R.list_items, {"(1)(2) x( 1 ) 3(4)": ["1", "2"]}),
        (R.without_extraction_spaces, {"日本 語\nの  word two": "日本語のword two"}),
        (R.local_path, {"a%20b/c.png?x": "a b/c.png", "http://h/a": None, "//h/a": None, "../a": None, "a/../../b": None, "/etc": None, "bad%zz.png": "bad%zz.png", "a+b%2F..%2F..": None}),
        (R.token_count, {"12": 12, "-1": None, "1.5": None, "true": None}),
    ],
)
def test_rules(spark, rule, cases):
    for text, want in cases.items():
        got = value(spark, rule, a=text)
        assert (str(got) if rule is R.date_value and got else got) == want, (text, got)


def test_section_and_position(spark):
    for a, b, want in (("5 A", "3 B", 2), ("5.1", "1", 5), ("Abstract", "3", None)):
        assert value(spark, R.section_distance, a=a, b=b) == want
    assert value(spark, R.section_penalty, a="5 A", b="Abstract") == 0.3 and value(spark, R.section_penalty, a="Abstract", b="5") == 0.0
    assert value(spark, R.position_penalty, a="0.1", b="none") == 0.0 and value(spark, R.position_penalty, a="0.0", b="5") == 3.0


def plain_batches(sizes, budget, most):
    out, used, n, batch = [], 0, 0, 0
    for s in sizes:
        if n and (used + s > budget or n >= most):
            batch, used, n = batch + 1, 0, 0
        out.append(batch)
        used, n = used + s, n + 1
    return out


def test_front_page_and_lines(spark):
    a, b = ({r.doc_id: r.t for r in df.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("t")).collect()} for df in (V.units(spark, SF), V.version2(spark, SF)))
    got = defaultdict(list)
    for r in structures.line_diff(spark, SF).orderBy("doc_id", "k").collect():
        got[r.doc_id].append(r.line)
    for d in sorted(b)[:60]:
        assert got.get(d, []) == list(difflib.unified_diff(a[d], b[d], lineterm="", n=0))[2:]
    pages = [defaultdict(list), defaultdict(list)]
    for k, df in enumerate((V.units(spark, SF), V.version2(spark, SF))):
        for r in df.orderBy("doc_id", "ord").collect():
            if r.ord < 10:
                pages[k][r.doc_id].append(r.text)
    want = {}
    for d in set(pages[0]) & set(pages[1]):
        x, y = (" ".join(" ".join(p[d]).lower().split()) for p in pages)
        if min(len(x), len(y)) >= 100:
            want[d] = difflib.SequenceMatcher(None, x, y).ratio()
    found = {r.doc_id: r for r in structures.front_page_copy(spark, SF).collect()}
    assert set(found) == set(want) and all(abs(found[d].ratio - v) < 1e-6 and found[d].copied == (v >= 0.85) for d, v in want.items())


def test_pieces_by_hand(spark):
    units = V.units(spark, SF).orderBy("doc_id", "ord").collect()
    spans = defaultdict(list)
    for r in V.spans(spark, SF).orderBy("unit_id", "span_ord").collect():
        spans[r.unit_id].append(len(r.source.encode()))

    def cut(budget):
        for u in units:
            size = len(u.text.encode())
            if size <= budget:
                yield u.doc_id, u.ord, 0, size, 0
            else:
                at, sizes = plain_batches(spans[u.unit_id], budget, 1 << 30), spans[u.unit_id]
                for b in sorted(set(at)):
                    own = [n for x, n in zip(at, sizes, strict=True) if x == b]
                    yield u.doc_id, u.ord, b, sum(own), len(own)

    got = sorted((r.doc_id, r.ord, r.piece, r.bytes, r.spans, r.oversize) for r in structures.unit_pieces(spark, SF).collect())
    assert got == sorted((*x, x[3] > 600) for x in cut(600)) and any(x[2] for x in got)
    by = defaultdict(list)
    for d, *_, size, _n in cut(1500):
        by[d].append(size)
    want = Counter()
    for d, sizes in by.items():
        for b, n in zip(plain_batches(sizes, 1500, 64), sizes, strict=True):
            want[d, b] += n
    assert {(r.doc_id, r.batch): r.bytes for r in structures.piece_batches(spark, SF).collect()} == dict(want)
