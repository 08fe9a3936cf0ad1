"""Reading order of page items, and fragments of a text put together again.

Columns and bands are learned from the boxes of each page of each container: a column begins where a left edge lies farther from the
last column than six tenths of the median width; bands are the unions of the columns' vertical extents, so a title across the page
that no column reaches is a band before the text, and where extents cross they are one band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.aggregates import bands
from quire.plans.registry import query
from quire.sources import views as V
from quire.sources.views import sql

PAGE = ["container", "page"]
#: Labels outside of a page's text, by where they go; share of the median width that parts columns.
FIRST, LAST, APART = ("page_header",), ("page_footer", "footnote"), 0.6
#: Labels whose fragments go together, those of one line, and what stands between: tenths of overlap, points of gap.
GOES_ON, ON_A_LINE, BY_LINES, OVERLAP, GAP = ("text", "paragraph", "code", "program_listing"), ("text", "paragraph"), ("code", "program_listing"), 7, (-2, 20)


def has_box() -> Column:
    return F.coalesce(F.expr("l < r AND t < b"), F.lit(False))


def samples(items: DataFrame) -> DataFrame:
    """The boxes that columns and bands are learned from."""
    return items.where(has_box() & ~F.col("label").isin(*FIRST, *LAST))


def columns_of(boxes: DataFrame) -> DataFrame:
    """(container, page, columns): left edges of each page's columns, by a fold over the sorted edges."""
    width = F.percentile(F.greatest(F.lit(1.0), F.col("r") - F.col("l")), 0.5) * APART
    g = boxes.groupBy(*PAGE).agg(width.alias("tolerance"), F.array_sort(F.collect_list(F.col("l").cast("double"))).alias("edges"))
    new = lambda a, x: (F.size(a) == 0) | (x - F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) > F.col("tolerance"))
    fold = F.aggregate("edges", F.array().cast("array<double>"), lambda a, x: F.when(new(a, x), F.concat(a, F.array(x))).otherwise(a))
    return g.select(*PAGE, fold.alias("columns"))


def nearest(columns: str, left: Column) -> Column:
    """Place of the nearest column, the first of two as near."""
    return F.array_min(F.transform(columns, lambda c, i: F.struct(F.abs(c - left).alias("d"), i.alias("i"))))["i"]


def extents(boxes: DataFrame, columns: DataFrame) -> DataFrame:
    """(container, page, column, top, bottom) of each column that a box is nearest to."""
    near = boxes.join(columns, PAGE).withColumn("column", nearest("columns", F.col("l")))
    return near.groupBy(*PAGE, "column").agg(F.min("t").alias("top"), F.max("b").alias("bottom"))


def reading_order_of(items: DataFrame) -> DataFrame:
    """items with `place` from 0 in their container: by page, header, band, column, top, centre, left edge and idx.

    items: (container, page, idx, label, fixed, l, t, r, b, ...). Items without a box of some extent come last, by idx; so does
    nothing move where fixed is true (the lines of a form)."""
    boxes = samples(items.where("NOT fixed"))
    columns = columns_of(boxes)
    ext = extents(boxes, columns).withColumn("by", F.struct(*PAGE))
    ends = bands(ext, "by", "top", "bottom").groupBy(*PAGE, "band").agg(F.max("bottom").alias("end")).groupBy(*PAGE).agg(F.collect_list("end").alias("ends"))
    known = items.join(columns, PAGE, "left").join(ends, PAGE, "left")
    region = F.when(F.col("label").isin(*FIRST), 0).when(F.col("label").isin(*LAST), 2).otherwise(1)
    band = F.coalesce(F.size(F.filter("ends", lambda e: e < F.col("t"))), F.lit(0))
    column = F.coalesce(nearest("columns", F.col("l")), F.lit(0))
    moved = ~F.col("fixed") & has_box()
    key = F.when(moved, F.struct(F.col("page").alias("page"), region.alias("region"), band.alias("band"), column.alias("column"), F.col("t").alias("t"), (F.col("t") + F.col("b")).alias("center"), F.col("l").alias("l")))
    w = Window.partitionBy("container").orderBy((~moved).cast("int"), key, "idx")
    return known.withColumn("place", F.row_number().over(w) - 1).select(*items.columns, "place")


def fragments(ordered: DataFrame) -> DataFrame:
    """ordered with `goes_on` (an item continues the one before it in its container) and `joined` (and may be put to it).

    ordered: reading_order_of's rows with style (what else must agree) and owned (referred to exactly once, by its own name, and owning nothing).
    A chain's last box decides, which is that of the item before. In a fixed container only items of one line go together."""
    w = Window.partitionBy("container").orderBy("place")
    last = {c: F.lag(c).over(w) for c in ("page", "label", "l", "t", "r", "b", "style", "owned")}
    x = ordered.withColumns({f"p_{c}": v for c, v in last.items()})
    alike = (F.col("label") == F.col("p_label")) & (F.col("page") == F.col("p_page"))
    across = F.expr("greatest(0, least(p_r, r) - greatest(p_l, l)) * 10 >= %d * greatest(1, least(p_r - p_l, r - l))" % OVERLAP) & (F.col("t") - F.col("p_b")).between(*GAP) & F.col("label").isin(*GOES_ON)
    along = F.expr("greatest(0, least(p_b, b) - greatest(p_t, t)) * 10 >= %d * greatest(1, least(p_b - p_t, b - t))" % OVERLAP) & (F.col("p_r") <= F.col("l")) & F.col("label").isin(*ON_A_LINE)
    goes_on = F.coalesce(alike & F.when(F.col("fixed"), along).otherwise(across), F.lit(False))
    may = F.col("owned") & F.col("p_owned") & F.col("style").eqNullSafe(F.col("p_style"))
    return x.withColumn("goes_on", goes_on).withColumn("joined", goes_on & may).select(*ordered.columns, "goes_on", "joined")


def chained(marked: DataFrame) -> DataFrame:
    """(container, head, parts, ids, text): each chain of fragments as one item; a space between them, a line end in code."""
    w = Window.partitionBy("container").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = marked.withColumn("chain", F.sum((~F.col("joined")).cast("int")).over(w))
    g = rows.groupBy("container", "chain").agg(F.sort_array(F.collect_list(F.struct("place", "idx", "text"))).alias("x"), F.first("label").alias("label"))
    between = F.when(F.col("label").isin(*BY_LINES), "\n").otherwise(" ")
    texts = F.transform("x", lambda x: x["text"])
    joined = F.aggregate(F.slice(texts, F.lit(2), F.greatest(F.size(texts) - 1, F.lit(0))), F.get(texts, F.lit(0)), lambda a, s: F.concat(F.regexp_replace(a, r"\s+$", ""), between, F.regexp_replace(s, r"^\s+", "")))
    ids = F.array_join(F.transform("x", lambda x: x["idx"].cast("string")), ",")
    return g.select("container", F.get("x", F.lit(0))["idx"].alias("head"), F.size("x").cast("long").alias("parts"), ids.alias("ids"), joined.alias("text"))


#: Page items with labels, some across the page, some without a box; the third document in three is a form of lines.
ITEM = {
    "container": "page // 5",
    "label": "CASE WHEN id % 23 = 0 THEN 'page_header' WHEN id % 29 = 0 THEN 'page_footer' WHEN id % 31 = 0 THEN 'footnote' WHEN id % 17 = 0 THEN 'caption' WHEN (page + id) % 3 = 0 THEN 'code' WHEN page % 2 = 0 THEN 'text' ELSE 'paragraph' END",
    "fixed": "page // 5 % 3 = 2",
    "l": "CASE WHEN id % 37 = 0 THEN NULL WHEN id % 13 = 0 THEN 4 WHEN page // 5 % 3 = 2 THEN id % 3 * 200 ELSE l END",
    "r": "CASE WHEN id % 13 = 0 THEN 590 WHEN page // 5 % 3 = 2 THEN id % 3 * 200 + (r - l) ELSE r END",
    "t": "CASE WHEN page // 5 % 3 = 2 THEN id // 3 % 20 * 18 + id % 5 ELSE t END",
    "b": "CASE WHEN page // 5 % 3 = 2 THEN id // 3 % 20 * 18 + id % 5 + (b - t) ELSE b END",
    "style": "CASE WHEN id % 19 = 0 THEN 'bold' END",
    "owned": "id % 41 <> 0",
    "text": "CASE WHEN id % 7 = 0 THEN ' ' || text || '  ' ELSE text END",
}
_ITEMS = "SELECT id AS idx, page, " + ", ".join(f"{e} AS {n}" for n, e in ITEM.items()) + " FROM v_boxes"


def page_items(spark, sf_dir) -> DataFrame:
    div = lambda e: e.replace("page // 5", "(page div 5)").replace("id // 3", "(id div 3)")
    return V.boxes(spark, sf_dir).select(F.col("id").alias("idx"), "page", *[F.expr(div(e)).alias(n) for n, e in ITEM.items()])


_LEARNED = f"""v_items AS ({_ITEMS}), v_smp AS (SELECT * FROM v_items WHERE NOT fixed AND l < r AND t < b AND label NOT IN {FIRST + LAST}),
v_cols AS (SELECT container, page, list_reduce(list_transform(edges, lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[-1] > tol THEN list_concat(a, x) ELSE a END) AS cols FROM (SELECT container, page, quantile_cont(greatest(1, r - l)::DOUBLE, 0.5) * {APART} AS tol, list(l::DOUBLE ORDER BY l) AS edges FROM v_smp GROUP BY 1, 2)),
v_ext AS (SELECT container, page, cols[col + 1] AS anchor, min(t) AS top, max(b) AS bottom FROM (SELECT s.*, cols, list_position(list_transform(cols, lambda c: abs(c - l)), list_min(list_transform(cols, lambda c: abs(c - l)))) - 1 AS col FROM v_smp s JOIN v_cols USING (container, page)) GROUP BY 1, 2, 3),
v_ends AS (SELECT container, page, list(e) AS ends FROM (SELECT container, page, band, max(bottom) AS e FROM (SELECT *, sum(new) OVER (PARTITION BY container, page ORDER BY top, bottom ROWS UNBOUNDED PRECEDING) AS band FROM (SELECT *, CASE WHEN top <= max(bottom) OVER (PARTITION BY container, page ORDER BY top, bottom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM v_ext)) GROUP BY 1, 2, 3) GROUP BY 1, 2),
v_read AS (SELECT * EXCLUDE (cols, ends, moved), row_number() OVER (PARTITION BY container ORDER BY NOT moved, CASE WHEN moved THEN page END, CASE WHEN NOT moved THEN 0 WHEN label IN ('page_header') THEN 0 WHEN label IN {LAST} THEN 2 ELSE 1 END,
  CASE WHEN moved THEN coalesce(len(list_filter(ends, lambda e: e < t)), 0) END, CASE WHEN moved THEN coalesce(list_position(list_transform(cols, lambda c: abs(c - l)), list_min(list_transform(cols, lambda c: abs(c - l)))), 1) END, CASE WHEN moved THEN t END, CASE WHEN moved THEN t + b END, CASE WHEN moved THEN l END, idx) - 1 AS place
  FROM (SELECT *, NOT fixed AND coalesce(l < r AND t < b, false) AS moved FROM v_items LEFT JOIN v_cols USING (container, page) LEFT JOIN v_ends USING (container, page)))"""
_LEARNED = _LEARNED.replace(str(FIRST + LAST), "('page_header', 'page_footer', 'footnote')").replace(str(LAST), "('page_footer', 'footnote')")


def learned_sql(body: str, *more: str) -> str:
    return f"WITH v_boxes AS ({V.SQL['v_boxes']}),\n{_LEARNED}" + "".join(f",\n{m}" for m in more) + f"\n{body}"


@query(learned_sql("SELECT container, page, idx, place FROM v_read"))
def reading_order(spark, sf_dir):
    return reading_order_of(page_items(spark, sf_dir)).select("container", "page", "idx", "place")


@query(learned_sql("SELECT container, page, anchor, top, bottom FROM v_ext"))
def column_extents(spark, sf_dir):
    """The extent of each learned column; items belong to the nearest, the first where two are as near."""
    boxes = samples(page_items(spark, sf_dir).where("NOT fixed"))
    columns = columns_of(boxes)
    named = extents(boxes, columns).join(columns, PAGE)
    return named.select(*PAGE, F.get("columns", F.col("column")).alias("anchor"), "top", "bottom")


_MARKED = f"""v_mark AS (SELECT *, on_ AND owned AND p_owned AND style IS NOT DISTINCT FROM p_style AS joined FROM (SELECT *, coalesce(label = p_label AND page = p_page AND CASE WHEN fixed
 THEN label IN ('text', 'paragraph') AND greatest(0, least(p_b, b) - greatest(p_t, t)) * 10 >= {OVERLAP} * greatest(1, least(p_b - p_t, b - t)) AND p_r <= l
 ELSE label IN ('text', 'paragraph', 'code', 'program_listing') AND greatest(0, least(p_r, r) - greatest(p_l, l)) * 10 >= {OVERLAP} * greatest(1, least(p_r - p_l, r - l)) AND t - p_b BETWEEN {GAP[0]} AND {GAP[1]} END, false) AS on_
 FROM (SELECT *, """ + ", ".join(f"lag({c}) OVER w AS p_{c}" for c in ("page", "label", "l", "t", "r", "b", "style", "owned")) + " FROM v_read WINDOW w AS (PARTITION BY container ORDER BY place))))"  # fmt: skip
_JOIN = "regexp_replace(a, '\\s+$', '') || CASE WHEN label IN ('code', 'program_listing') THEN chr(10) ELSE ' ' END || regexp_replace(x, '^\\s+', '')"


@query(learned_sql(f"SELECT container, xs[1] AS head, len(xs)::BIGINT AS parts, array_to_string(xs, ',') AS ids, list_reduce(texts, lambda a, x: {_JOIN}) AS text FROM (SELECT container, chain, any_value(label) AS label, list(idx ORDER BY place) AS xs, list(text ORDER BY place) AS texts FROM (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY container ORDER BY place ROWS UNBOUNDED PRECEDING) AS chain FROM v_mark) GROUP BY 1, 2)", _MARKED))
def fragment_merge(spark, sf_dir):
    """Fragments of a text in reading order joined into chains, each with its whole text."""
    return chained(fragments(reading_order_of(page_items(spark, sf_dir))))


@query(learned_sql("SELECT container, idx FROM v_mark WHERE on_ AND NOT joined", _MARKED))
def fragment_conflicts(spark, sf_dir):
    """Items that go on from the one before, but are kept apart: what they own or how they look differs."""
    return fragments(reading_order_of(page_items(spark, sf_dir))).where("goes_on AND NOT joined").select("container", "idx")
