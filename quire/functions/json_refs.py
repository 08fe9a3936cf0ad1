"""References in JSON texts, read and rewritten in one pass over the strings of a text, whatever its depth and spacing.

In JSON every string that a colon follows is a key. So a key and a string as its value are met one after another, and no text
that only looks like a reference is taken for one. All else of the text stays as it is."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

_STRING = r'"[^"\\]*(?:\\.[^"\\]*)*"'
PAIR = re.compile(rf"({_STRING})(?:(\s*:\s*)({_STRING}))?", re.DOTALL)
TARGET, NAMES = "$ref", ("$ref", "self_ref")
INDEXED = re.compile(r"#/([^/]+)/(0|[1-9][0-9]*)((?:/.*)?)", re.DOTALL)


def pairs(text: str | None) -> Iterator[tuple[str, str]]:
    """Keys and their string values, in order."""
    for m in PAIR.finditer(text or ""):
        if m[3]:
            yield json.loads(m[1], strict=False), json.loads(m[3], strict=False)


def refs_of(text: str | None) -> list[str]:
    """All different references below a node, sorted."""
    return sorted({value for key, value in pairs(text) if key == TARGET})


def rewritten(text: str | None, new: Callable[[str], str]) -> str | None:
    """The text with new() of every reference and every node's own name."""

    def one(m: re.Match) -> str:
        if not m[3] or json.loads(m[1], strict=False) not in NAMES:
            return m[0]
        value = json.loads(m[3], strict=False)
        changed = new(value)
        return m[0] if changed == value else m[1] + m[2] + json.dumps(changed, ensure_ascii=False)

    return None if text is None else PAIR.sub(one, text)


def mapped(text: str | None, old: list[str] | None, new: list[str] | None) -> str | None:
    """References renamed by pairs of old and new: the whole reference, else the node that it lies in."""
    names = dict(zip(old if old is not None else [], new if new is not None else [], strict=True))

    def one(ref: str) -> str:
        if ref in names:
            return names[ref]
        root, rest = "/".join(ref.split("/")[:3]), ref.split("/")[3:]
        return "/".join([names[root], *rest]) if root in names else ref

    return rewritten(text, one)


def shifted(text: str | None, collections: list[str] | None, by: list[int] | None) -> str | None:
    """References into each named collection moved on by so many places: a part's nodes behind those of the parts before."""
    moves = dict(zip(collections if collections is not None else [], by if by is not None else [], strict=True))

    def one(ref: str) -> str:
        m = INDEXED.fullmatch(ref)
        return f"#/{m[1]}/{int(m[2]) + int(moves[m[1]])}{m[3]}" if m and m[1] in moves else ref

    return rewritten(text, one)
