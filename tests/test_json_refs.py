"""References in JSON texts against a walk over the parsed value."""

import hashlib
import json
import random

import pytest

from quire.functions import json_refs as J
from quire.operators import texts
from quire.sources import views as V

REFS = ["#/texts/0", "#/texts/12", "#/texts/12/cell/3", "#/tables/1", "#/body", "#/texts/x", "other", '#/texts/3/"q"', "#/texts/1\n", "#/ü/4"]


def tree(g, depth=0):
    kind = g.randrange(6 if depth < 6 else 3)
    if kind < 2:
        return g.choice(['says "$ref": "#/texts/0"', '{"self_ref":"#/texts/12"}', "back\\slash\\", "ü\u2028\x07", "", 3, None, True, 1.5, *REFS])
    if kind < 4:
        return [tree(g, depth + 1) for _ in range(g.randrange(4))]
    node = {g.choice(["$ref", "self_ref", "text", "a:b", '"', "$ref ", "refs"]): g.choice(REFS) for _ in range(g.randrange(4))}
    return node | {f"k{i}": tree(g, depth + 1) for i in range(g.randrange(3))}


def walk(value, new):
    if isinstance(value, list):
        return [walk(x, new) for x in value]
    if isinstance(value, dict):
        return {k: new(v) if k in ("$ref", "self_ref") and isinstance(v, str) else walk(v, new) for k, v in value.items()}
    return value


def found(value):
    if isinstance(value, list):
        return set().union(*map(found, value), set())
    if isinstance(value, dict):
        return {v for k, v in value.items() if k == "$ref" and isinstance(v, str)}.union(*map(found, value.values()))
    return set()


@pytest.mark.parametrize("form", [{}, {"indent": 2}, {"separators": (",", ":")}, {"separators": (" , ", "\t:\n"), "ensure_ascii": False}])
def test_walker(form):
    names = {"#/texts/12": "#/texts/5", "#/texts/12/cell/3": "#/cells/9", "#/tables/1": '#/tables/"0"'}

    def by_names(ref):
        root = "/".join(ref.split("/")[:3])
        return names.get(ref) or (names[root] + ref[len(root) :] if root in names else ref)

    def by_place(ref):
        parts = ref.split("/", 3)
        inside = len(parts) > 2 and parts[0] == "#" and parts[1] in ("texts", "ü") and parts[2].isdigit()
        return "/".join(["#", parts[1], str(int(parts[2]) + 100), *parts[3:]]) if inside else ref

    g = random.Random(4)
    for _ in range(400):
        value = tree(g)
        text = json.dumps(value, **form)
        assert J.refs_of(text) == sorted(found(value))
        assert json.loads(J.mapped(text, list(names), list(names.values()))) == walk(value, by_names)
        assert json.loads(J.shifted(text, ["texts", "ü"], [100, 100])) == walk(value, by_place)
        assert J.mapped(text, [], []) == text
    assert J.refs_of(None) == [] and J.mapped(None, [], []) is None and J.shifted("", None, None) == ""
    deep = '{"a":' * 50_000 + '{"$ref" : "#/texts/1"}' + "}" * 50_000
    assert J.refs_of(deep) == ["#/texts/1"] and "#/texts/3" in J.shifted(deep, ["texts"], [2])


def test_canonical_hashes_of_all_rows(spark):
    sf = "/root/testdata/sf0.001"
    rows = V.marked(spark, sf).collect()
    got = {r.unit_id: (r.sha, r.bytes) for r in texts.canonical_hashes(spark, sf).collect()}
    assert len(got) == len(rows) and any("\x07" in r.raw for r in rows)
    for r in rows:
        record = {"unit_id": r.unit_id, "ord": r.ord, "raw": r.raw}
        canon = json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert got[r.unit_id] == (hashlib.sha256(canon.encode()).hexdigest(), len(json.dumps(record, ensure_ascii=False).encode()))
