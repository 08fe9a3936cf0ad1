"""Index items against the rule followed item by item in plain Python."""

import random
import re

from quire.functions import rules as R
from quire.operators import indexes

TEXTS = ["Contents", " contents ", "List of tables", "Chapter 1", "Intro .... 3", "Intro…iv", "a\n Deep .. xi \nb", "Intro\t9", "plain", "", None]
LABELS = ["section_header", "title", "text", "list_item", "document_index", "document_index", "table", None]


def data(seed):
    g = random.Random(seed)
    items, cells = [], []
    for k in range(400):
        items.append((g.choice([1, 2, None]), f"i{k}", k, g.choice([1, 2, 3, 4, 5, 6, 7, None]), g.choice(LABELS), g.choice(TEXTS)))
        if g.random() < 0.5:
            width, last = g.choice([1, 2, 3]), g.choice([["1", "22", "IV", " 7 "], ["1", "x1", ""], ["", None, " "]])
            for _ in range(g.randint(1, 4)):
                for col in range(width):
                    cells.append((f"i{k}", col, g.choice([True, False, False, None]), g.choice(last) if col == width - 1 else g.choice(["name", "name", "name", "name .. 4", None])))
    return items + [items[5]], cells + [("unknown", 0, False, "x .. 1")]


def entry(text):
    return re.search(R.INDEX_ENTRY.replace("(?i)", ""), text.strip(), re.I) is not None


def walked(items, cells):
    """In the items' order, with a set of index pages that grows."""
    rows = sorted(items, key=lambda r: r[2])
    pages = set()
    why = {}
    for doc, item, _, page, label, text in rows:
        if label in indexes.HEADINGS and re.search(R.INDEX_TITLE.replace("(?i)", ""), (text or "").strip(), re.I):
            why[item] = "title"
            pages |= {(doc, page)} if page is not None else set()
    for doc, item, _, page, label, text in rows:
        if label == indexes.INDEX:
            mine = [c for c in cells if c[0] == item]
            last = max((c[1] for c in mine), default=0)
            numbers = [c[3].strip() for c in mine if last > 0 and c[1] == last and not c[2] and (c[3] or "").strip()]
            if any(entry(x) for t in [text, *(c[3] for c in mine)] for x in (t or "").splitlines()):
                why[item] = "leader"
                pages |= {(doc, page)} if page is not None else set()
            elif (doc, page) in pages and numbers and all(re.fullmatch("[0-9]+|[ivxlcdm]+", n, re.I) for n in numbers):
                why[item] = "numbers"
    for doc, item, _, page, label, text in rows:
        if label in indexes.ENTRIES and (doc, page) in pages and entry(text or ""):
            why[item] = "entry"
    return sorted((r[1], why[r[1]]) for r in items if r[1] in why)


def test_index_items_equal_a_walk(spark):
    kinds = set()
    for seed in range(3):
        items, cells = data(seed)
        df = spark.createDataFrame(items, "doc long, item string, ord long, page int, label string, text string")
        got = indexes.index_items(df, spark.createDataFrame(cells, "item string, col int, header boolean, text string"))
        assert sorted((r.item, r.why) for r in got.collect()) == walked(items, cells)
        kinds |= {r.why for r in got.collect()}
    assert kinds == {"title", "leader", "numbers", "entry"}


def test_empty_tables(spark):
    items, cells = "doc long, item string, ord long, page int, label string, text string", "item string, col int, header boolean, text string"
    assert indexes.index_items(spark.createDataFrame([], items), spark.createDataFrame([], cells)).count() == 0
    one = spark.createDataFrame([(1, "a", 1, None, "document_index", "x ... 3 " + "long " * 100_000), (1, "b", 2, 1, "list_item", "x .. 3")], items)
    assert indexes.index_items(one, spark.createDataFrame([], cells)).collect() == []
