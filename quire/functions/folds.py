"""Ordered folds over one document's parts, linear in them: batches, parts of what is too large, edits in their order.

Sizes are bytes of texts as JSON strings, where some signs take an escape."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from itertools import accumulate

from quire.functions.text import sentences_of

#: Bytes of a sign as JSON writes it.
ESCAPED = dict.fromkeys(map(chr, range(32)), 6) | dict.fromkeys('"\\\n\r\t\b\f', 2)


def offsets(text: str) -> list[int]:
    """Bytes before each sign of a text, and in all."""
    return [0, *accumulate(ESCAPED.get(c) or len(c.encode("utf-8", "replace")) for c in text)]


def batch_numbers(sizes: Sequence[int] | None, budget: int, most: int, marks: Sequence[int] | None = None) -> list[int]:
    """Batch of each item in order: at most `most` items and `budget` in sum, a larger item alone; items of another mark begin a new one."""
    out, batch, used, n, mark = [], 0, 0, 0, None
    for i, size in enumerate(sizes if sizes is not None else []):
        own = marks[i] if marks is not None else None
        if n and (used + size > budget or n >= most or own != mark):
            batch, used, n = batch + 1, 0, 0
        out.append(batch)
        used, n, mark = used + int(size), n + 1, own
    return out


def cut_at(before: list[int], start: int, room: int) -> int:
    """The end of the longest piece from start that takes `room` bytes at most, but a sign at least."""
    return max(start + 1, bisect_right(before, before[start] + room) - 1)


def pieces_of(spans: Sequence[str] | None, budget: int, fixed: int) -> list[dict]:
    """(span, start, end, spans, bytes) of a block over budget: runs of whole spans, and pieces of a span that doesn't fit alone.

    start and end count signs of the first and the last span of a piece; fixed: bytes of a block besides its spans. Without spans, one empty piece."""
    texts, out, first, used = list(spans if spans is not None else []), [], None, fixed

    def run_to(k: int) -> None:
        if first is not None:
            out.append({"span": first, "start": 0, "end": len(texts[k - 1]), "spans": k - first, "bytes": used})

    for k, text in enumerate(texts):
        before = offsets(text)
        if used + before[-1] > budget:
            run_to(k)
            first, used = None, fixed
        if fixed + before[-1] > budget:
            start = 0
            while start < len(text):
                end = cut_at(before, start, budget - fixed)
                out.append({"span": k, "start": start, "end": end, "spans": 1, "bytes": fixed + before[end] - before[start]})
                start = end
            continue
        first, used = k if first is None else first, used + before[-1]
    run_to(len(texts))
    return out or [{"span": 0, "start": 0, "end": 0, "spans": 0, "bytes": fixed}]


def review_parts(source: str | None, spans: Sequence[str] | None, budget: int, fixed: int) -> list[dict]:
    """(part, start, end, span, spans, bytes) of a target: groups of spans that fit, each with the sentences of the source that still fit, then parts of the source alone.

    start and end count signs of the source. A target within budget is one part. A sentence or a span that doesn't fit alone is cut, a sentence where the budget ends."""
    source, spans = source or "", list(spans if spans is not None else [])
    before, sizes = offsets(source), [offsets(s)[-1] for s in spans]
    if fixed + before[-1] + sum(sizes) <= budget:
        return [{"part": 0, "start": 0, "end": len(source), "span": 0, "spans": len(spans), "bytes": fixed + before[-1] + sum(sizes)}]
    ends = list(accumulate(map(len, sentences_of(source))))
    at_ends = [before[e] for e in ends]
    groups: list[list[int]] = []  # first span, how many, bytes
    for k, size in enumerate(sizes):
        if not groups or groups[-1][2] + size > budget:
            groups.append([k, 0, fixed])
        groups[-1][1] += 1
        groups[-1][2] += size
    out, at = [], 0
    for first, many, used in groups or [[0, 0, fixed]]:
        k = bisect_right(at_ends, before[at] + budget - used)
        end = max(at, ends[k - 1]) if k else at
        out.append((at, end, first, many, used + before[end] - before[at]))
        at = end
    while at < len(source):
        k = bisect_right(at_ends, before[at] + budget - fixed)
        end = ends[k - 1] if k and ends[k - 1] > at else cut_at(before, at, budget - fixed)
        out.append((at, end, len(spans), 0, fixed + before[end] - before[at]))
        at = end
    return [{"part": i, "start": a, "end": b, "span": s, "spans": n, "bytes": size} for i, (a, b, s, n, size) in enumerate(out, 1)]


def results_in_order(reasons: Sequence[str | None] | None, spans: Sequence[Sequence[str]] | None) -> list[str]:
    """What each revision comes to: its reason, a conflict with a span that an applied one has changed, or applied."""
    changed: set[str] = set()
    out = []
    for reason, own in zip(reasons if reasons is not None else [], spans if spans is not None else [], strict=True):
        result = reason or ("conflicting_edit" if changed.intersection(own) else "applied")
        if result == "applied":
            changed.update(own)
        out.append(result)
    return out
