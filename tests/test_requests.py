"""Batches, parts, budgets and edits against plain Python that tries every prefix."""

import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quire.functions import folds
from quire.functions.text import sentences_of
from quire.operators import requests, windows
from quire.sources import views as V

SF = "/root/testdata/sf0.001"
WORDS = ["One. ", "Two three! ", "four\n", 'quo"te ', "日本。", "ü", "back\\ ", "\x07", "long" * 9 + ". "]


def size(*texts):
    return sum(len(json.dumps(t, ensure_ascii=False).encode()) - 2 for t in texts)


def longest(text, room):
    return next(n for n in range(len(text), 0, -1) if n == 1 or size(text[:n]) <= room)


def plain_pieces(spans, budget, fixed):
    out, run = [], []
    for k, s in enumerate(spans):
        if run and fixed + size(*[spans[i] for i in run], s) > budget:
            out.append((run[0], 0, len(spans[run[-1]]), len(run), fixed + size(*[spans[i] for i in run])))
            run = []
        if fixed + size(s) <= budget:
            run.append(k)
            continue
        at = 0
        while at < len(s):
            n = longest(s[at:], budget - fixed)
            out.append((k, at, at + n, 1, fixed + size(s[at : at + n])))
            at += n
    if run or not out:
        out.append((run[0], 0, len(spans[run[-1]]), len(run), fixed + size(*[spans[i] for i in run])) if run else (0, 0, 0, 0, fixed))
    return out


def plain_parts(source, spans, budget, fixed):
    if fixed + size(source, *spans) <= budget:
        return [(0, 0, len(source), 0, len(spans), fixed + size(source, *spans))]
    groups = []
    for k, s in enumerate(spans):
        if groups and fixed + size(*[spans[i] for i in groups[-1]], s) <= budget:
            groups[-1].append(k)
        else:
            groups.append([k])
    ends = {0}
    for s in sentences_of(source):
        ends.add(max(ends) + len(s))
    out, at = [], 0
    for g in groups or [[]]:
        used = fixed + size(*[spans[i] for i in g])
        end = max(e for e in ends if e == at or (e > at and used + size(source[at:e]) <= budget)) if at in ends else at
        out.append((at, end, g[0] if g else 0, len(g), used + size(source[at:end])))
        at = end
    while at < len(source):
        fit = [e for e in ends if e > at and fixed + size(source[at:e]) <= budget]
        end = max(fit) if fit else at + longest(source[at:], budget - fixed)
        out.append((at, end, len(spans), 0, fixed + size(source[at:end])))
        at = end
    return [(i, *x) for i, x in enumerate(out, 1)]


@pytest.mark.parametrize("seed", range(40))
def test_parts_and_pieces(seed):
    g = random.Random(seed)
    spans = ["".join(g.choice(WORDS) for _ in range(g.randrange(6))) for _ in range(g.randrange(7))]
    source = "".join(g.choice(WORDS) for _ in range(g.randrange(30)))
    fixed, budget = 10, g.choice([12, 20, 35, 60, 120])
    pieces = [tuple(p.values()) for p in folds.pieces_of(spans, budget, fixed)]
    assert pieces == plain_pieces(spans, budget, fixed)
    parts = [tuple(p.values()) for p in folds.review_parts(source, spans, budget, fixed)]
    assert parts == plain_parts(source, spans, budget, fixed)
    assert "".join(source[p[1] : p[2]] for p in parts) == source
    assert all(p[4] <= budget or p[2] - p[1] == 1 for p in pieces if p[3] == 1)
    assert sum(p[4] for p in parts) == len(spans)


def plain_batches(sizes, budget, most, marks):
    out = []
    for i, n in enumerate(sizes):
        if out and marks[out[-1][0]] == marks[i] and len(out[-1]) < most and sum(sizes[k] for k in out[-1]) + n <= budget:
            out[-1].append(i)
        else:
            out.append([i])
    return [b for b, items in enumerate(out) for _ in items]


def test_batches():
    g = random.Random(1)
    for _ in range(200):
        sizes = [g.randrange(1, 40) for _ in range(g.randrange(30))]
        marks = [g.randrange(2) for _ in sizes]
        assert folds.batch_numbers(sizes, 60, 4, marks) == plain_batches(sizes, 60, 4, marks)
        assert folds.batch_numbers(sizes, 60, 4) == plain_batches(sizes, 60, 4, [0] * len(sizes))
    assert folds.batch_numbers(None, 1, 1) == [] and len(folds.batch_numbers([1] * 300_000, 100, 64)) == 300_000


def test_queries_on_given_tables(spark):
    spans, said = defaultdict(list), defaultdict(list)
    for r in V.spans(spark, SF).orderBy("doc_id", "ord", "span_ord").collect():
        spans[r.doc_id, r.ord].append(r.source)
        said[r.doc_id, r.ord] += [r.translated] if r.translated else []
    texts = {(r.doc_id, r.ord): r.text for r in V.units(spark, SF).collect()}
    parts, pieces = defaultdict(list), defaultdict(list)
    for (d, o), t in sorted(texts.items()):
        parts[d] += [(o, *p) for p in plain_parts(t, said[d, o], 1500, requests.TARGET_BYTES)]
        cut = plain_pieces(spans[d, o], 400, requests.BLOCK_BYTES)
        pieces[d] += [(o, k if len(cut) > 1 else 0, p) for k, p in enumerate(cut, 1)]
    want = []
    for d, ps in parts.items():
        numbers = plain_batches([p[6] for p in ps], 1500, 64, [p[5] > 0 for p in ps])
        want += [(d, b, p[0], p[1], p[6]) for b, p in zip(numbers, ps, strict=True)]
    assert sorted(map(tuple, requests.review_batches(spark, SF).collect())) == sorted(want)
    want = []
    for d, ps in pieces.items():
        numbers = plain_batches([p[2][4] for p in ps], 400, 64, [(p[0], p[1]) if p[1] else 0 for p in ps])
        want += [(d, b, o, k, p[0], p[1], p[2], p[4]) for b, (o, k, p) in zip(numbers, ps, strict=True)]
    assert sorted(map(tuple, requests.structure_batches(spark, SF).collect())) == sorted(want)
    small = {(r.doc_id, r.ord, r.part): (r.start, r.end, r.span, r.spans, r.bytes) for r in requests.split_target(spark, SF).collect()}
    assert small == {(d, o, p[0]): p[1:] for (d, o), t in texts.items() for p in plain_parts(t, said[d, o], 300, requests.TARGET_BYTES)}


def popped(targets, glossary, findings, refs, budget):
    refs = list(refs)
    kept_g = kept_f = True
    while True:
        total = targets + glossary * kept_g + findings * kept_f + sum(refs) + 2 * max(0, len(refs) - 1)
        if total <= budget:
            return len(refs), kept_g, kept_f, total
        if refs:
            refs.pop()
        elif kept_g:
            kept_g = False
        elif kept_f:
            kept_f = False
        else:
            return None, None, None, None


def test_what_is_dropped(spark):
    g = random.Random(3)
    asked = [(i, g.randrange(60), g.randrange(40), g.randrange(40)) for i in range(200)]
    refs = [(i, k, g.randrange(1, 30)) for i, *_ in asked for k in range(g.randrange(5))]
    got = requests.within_budget(spark.createDataFrame(asked, "request long, targets long, glossary long, findings long"), spark.createDataFrame(refs, "request long, rank int, bytes long"), 50)
    want = {i: popped(t, gl, f, [b for r, _, b in refs if r == i], 50) for i, t, gl, f in asked}
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == want


def test_revisions(spark):
    g = random.Random(5)
    own = {f"u{k}": [f"u{k}/s{i}" for i in range(3)] for k in range(8)}
    revs = [(d, i, f"u{g.randrange(9)}", [(f"u{g.randrange(3)}/s{g.randrange(4)}" if g.random() < 0.2 else f"u{g.randrange(9)}/s{g.randrange(3)}", g.choice(["x", "y", " ", None]) if g.random() < 0.3 else "z") for _ in range(g.randrange(1, 3))]) for d in range(5) for i in range(60)]
    revs = [(d, i, t, [(f"{t}/{s.split('/')[1]}" if g.random() < 0.8 else s, x) for s, x in e]) for d, i, t, e in revs]
    df = spark.createDataFrame(revs, "document int, id int, target string, edits array<struct<span:string,text:string>>").repartition(4)
    spans = spark.createDataFrame([(u, s) for u, ss in own.items() for s in ss], "target string, span string")
    got = {(r.document, r.id): r.result for r in requests.applied(df, spans).collect()}
    want, changed = {}, defaultdict(set)
    for d, i, t, edits in revs:
        ids = [s for s, _ in edits]
        if t not in own:
            reason = "unknown_target"
        elif set(ids) - set(own[t]):
            reason = "unknown_span"
        elif len(set(ids)) < len(ids):
            reason = "duplicate_edit"
        elif any(not (x or "").strip() for _, x in edits):
            reason = "empty_text"
        elif changed[d] & set(ids):
            reason = "conflicting_edit"
        else:
            reason = "applied"
            changed[d] |= set(ids)
        want[d, i] = reason
    assert got == want and len(set(want.values())) == 6
    assert requests.applied(df.where(F.lit(False)), spans).count() == 0


def test_observed_pages(spark):
    sizes = defaultdict(list)
    for r in V.units(spark, SF).orderBy("doc_id", "ord").collect():
        sizes[r.doc_id].append((r.ord, len(r.text.encode())))
    want = set()
    for d, items in sizes.items():
        numbers = plain_batches([n for _, n in items], 4000, 32, [0] * len(items))
        for page in set(numbers):
            own = [o for b, (o, _) in zip(numbers, items, strict=True) if b == page]
            want.add((d, page, own[0], len(own)))
    assert set(map(tuple, windows.observe_page(spark, SF).select("doc_id", "page", "first", "units").collect())) == want
