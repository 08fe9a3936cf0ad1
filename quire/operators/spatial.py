"""Joins of boxes by tiles: equi-joins on the page and a tile, each pair found in one tile only.

A box lies in every tile that it meets, a point in one. So a box within another is found in the tile of its corner, and two
boxes that overlap in the tile where their intersection begins. Work grows with the boxes and the pairs found, not with the square of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.plans.registry import query
from quire.sources import views as V
from quire.sources.views import sql

#: Points of a tile's side, about the size of an item.
TILE = 64


def tile(v: Column) -> Column:
    return F.floor(v / TILE)


def tiled(boxes: DataFrame, **spans: tuple[str, str]) -> DataFrame:
    """boxes once for each tile along each named axis: axis=(from, to). Boxes whose end is before their start, or null, are in none."""
    for axis, (start, end) in spans.items():
        boxes = boxes.where(F.col(start) <= F.col(end)).withColumn(axis, F.explode(F.sequence(tile(F.col(start)), tile(F.col(end)))))
    return boxes


def within(small: DataFrame, large: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of small (l, t, r, b) and large (L_, T_, R_, B_) of the same `on` of which the first lies within the second."""
    corner = small.withColumns({"tx": tile(F.col("l")), "ty": tile(F.col("t"))})
    whole = tiled(large, tx=("L_", "R_"), ty=("T_", "B_"))
    return corner.join(whole, [*on, "tx", "ty"]).where("l >= L_ AND t >= T_ AND r <= R_ AND b <= B_").drop("tx", "ty")


def overlapping(boxes: DataFrame, on: list[str]) -> DataFrame:
    """(*on, id, other), id before other, of boxes that share some area."""
    x = tiled(boxes.select(*on, "id", "l", "t", "r", "b"), tx=("l", "r"), ty=("t", "b"))
    y = x.select(*on, "tx", "ty", *[F.col(c).alias(f"{c}2") for c in ("id", "l", "t", "r", "b")])
    starts = (F.col("tx") == tile(F.greatest("l", "l2"))) & (F.col("ty") == tile(F.greatest("t", "t2")))
    return x.join(y, [*on, "tx", "ty"]).where("id < id2 AND l < r2 AND l2 < r AND t < b2 AND t2 < b").where(starts).select(*on, "id", F.col("id2").alias("other"))


def holding(points: DataFrame, at: Column, ranges: DataFrame, start: str, end: str, on: list[str]) -> DataFrame:
    """Pairs of points and ranges of the same `on` that hold them; at is null for a point that no range holds."""
    return points.withColumns({"at": at, "ta": tile(at)}).join(tiled(ranges, ta=(start, end)), [*on, "ta"]).where(F.col("at").between(F.col(start), F.col(end))).drop("at", "ta")


@query(sql("SELECT id, any_value(tab) AS tab FROM (SELECT i.id, t.id AS tab FROM v_boxes i JOIN v_boxes t ON i.page = t.page AND i.label = 'text' AND t.label = 'table' AND i.l >= t.l AND i.t >= t.t AND i.r <= t.r + 100 AND i.b <= t.b + 60) GROUP BY 1 HAVING count(*) = 1", "v_boxes"))
def image_in_table(spark, sf_dir):
    """Items that lie within exactly one table of their page (with some margin)."""
    b = V.boxes(spark, sf_dir)
    tables = b.where("label = 'table'").select("page", F.col("id").alias("tab"), F.col("l").alias("L_"), F.col("t").alias("T_"), (F.col("r") + 100).alias("R_"), (F.col("b") + 60).alias("B_"))
    inside = within(b.where("label = 'text'").select("page", "id", "l", "t", "r", "b"), tables, ["page"])
    return inside.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("tab").alias("tab")).where("n = 1").select("id", "tab")


#: Which column and row a cell's box heads, and to which it reaches.
_HEADS = "id % 5 AS col, id % 5 + CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END AS to_col, id % 7 AS row, id % 7 + CASE WHEN id % 6 = 0 THEN 1 ELSE 0 END AS to_row"
_IMAGES = "(SELECT id, page, l + r AS x2, t + b AS y2 FROM v_boxes WHERE label = 'image')"
_AXIS = "SELECT i.id, list_sort(list_distinct(flatten(list(generate_series(c.{0}, c.to_{0}))))) AS v FROM {1} i JOIN (SELECT *, {2} FROM v_boxes WHERE label = 'text') c ON c.page = i.page AND i.{3} BETWEEN 2 * c.{4} AND 2 * c.{5} GROUP BY 1"


@query(sql(f"SELECT id, c.v AS cols, r.v AS rows, len(c.v) = 1 AND len(r.v) = 1 AS certain FROM ({_AXIS.format('col', _IMAGES, _HEADS, 'x2', 'l', 'r')}) c JOIN ({_AXIS.format('row', _IMAGES, _HEADS, 'y2', 't', 'b')}) r USING (id)", "v_boxes").replace("c.v AS cols, r.v AS rows", "array_to_string(c.v, ',') AS cols, array_to_string(r.v, ',') AS rows"))
def image_to_cell(spark, sf_dir):
    """The columns whose heads hold an image's centre, and the rows: the union of what the heads span; certain if both are one."""
    b = V.boxes(spark, sf_dir)
    images = b.where("label = 'image'").select("page", "id", (F.col("l") + F.col("r")).alias("x2"), (F.col("t") + F.col("b")).alias("y2"))
    heads = b.where("label = 'text'").selectExpr("page", *_HEADS.replace("id %", "id %").split(", "), "2 * l AS x_from", "2 * r AS x_to", "2 * t AS y_from", "2 * b AS y_to")

    def spanned(at: str, start: str, end: str, first: str, last: str) -> DataFrame:
        found = holding(images.select("page", "id", at), F.col(at), heads.select("page", start, end, first, last), start, end, ["page"])
        return found.groupBy("id").agg(F.sort_array(F.collect_set(F.sequence(F.col(first), F.col(last)))).alias("v")).select("id", F.array_sort(F.array_distinct(F.flatten("v"))).alias("v"))

    cols, rows = spanned("x2", "x_from", "x_to", "col", "to_col"), spanned("y2", "y_from", "y_to", "row", "to_row")
    listed = lambda v: F.array_join(F.transform(v, lambda x: x.cast("string")), ",")
    both = cols.withColumnRenamed("v", "c").join(rows.withColumnRenamed("v", "r"), "id")
    return both.select("id", listed("c").alias("cols"), listed("r").alias("rows"), ((F.size("c") == 1) & (F.size("r") == 1)).alias("certain"))


@query(sql("""SELECT a.id, b.id AS other FROM v_boxes a JOIN v_boxes b ON a.page = b.page AND a.id < b.id AND a.l < b.r AND b.l < a.r AND a.t < b.b AND b.t < a.b""", "v_boxes"))
def cell_overlap(spark, sf_dir):
    """Rectangles of a page that overlap."""
    return overlapping(V.boxes(spark, sf_dir), ["page"]).select("id", "other")
