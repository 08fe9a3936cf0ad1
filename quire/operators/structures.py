"""Owners, geometry, vectors, ordered folds, sets and differences of versions."""

from __future__ import annotations

import difflib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import rules as R
from quire.functions.folds import batch_numbers
from quire.functions.text import by_row, chunks_of, sentences_of
from quire.plans.registry import query
from quire.sources import views as V
from quire.sources.files import settled, still_there
from quire.sources.views import CELLS, SPANS, UNITS, sql

# ---- owners of nodes ------------------------------------------------------------------------------


@query(sql("SELECT c.child, count(*) AS owners, bool_and(p.label <> 'text') AS safe FROM v_edges c JOIN v_edges p ON c.parent = p.child OR (c.child % 10 = 0 AND c.parent + 1 = p.child) GROUP BY 1 HAVING count(*) <> 1 OR NOT bool_and(p.label <> 'text')", "v_edges"))
def unsafe_refs(spark, sf_dir):
    """Nodes without exactly one proper owner."""
    e = V.edges(spark, sf_dir)
    owners = e.select(F.col("child").alias("p"), "label")
    links = e.select("child", F.explode(F.when(F.col("child") % 10 == 0, F.array("parent", F.col("parent") + 1)).otherwise(F.array("parent"))).alias("p"))
    g = links.join(owners, "p").groupBy("child").agg(F.count(F.lit(1)).alias("owners"), F.bool_and(F.col("label") != "text").alias("safe"))
    return g.where("owners <> 1 OR NOT safe")


# ---- geometry ----------------------------------------------------------------------------------


@query(sql("SELECT id, least(l, r) AS l, greatest(l, r) AS r, CASE WHEN id % 2 = 0 THEN -greatest(t, b) ELSE least(t, b) END AS t, CASE WHEN id % 2 = 0 THEN -least(t, b) ELSE greatest(t, b) END AS b FROM v_boxes", "v_boxes"))
def bbox_normalize(spark, sf_dir):
    """Left before right and down is larger, whichever origin the box has."""
    flip = F.col("id") % 2 == 0
    return V.boxes(spark, sf_dir).select("id", F.least("l", "r").alias("l"), F.greatest("l", "r").alias("r"), F.when(flip, -F.greatest("t", "b")).otherwise(F.least("t", "b")).alias("t"), F.when(flip, -F.least("t", "b")).otherwise(F.greatest("t", "b")).alias("b"))


@query(sql("SELECT id, l, r, h - b AS t, h - t AS b, coalesce(l < r AND t < b AND l >= 0 AND h - b >= 0 AND h > 0, false) AS valid FROM (SELECT *, max(b) OVER (PARTITION BY page) AS h FROM (SELECT * REPLACE (CASE WHEN id % 11 = 0 THEN t - 1 ELSE b END AS b) FROM v_boxes))", "v_boxes"))
def bbox_topleft(spark, sf_dir):
    """Boxes counted from the top of their own page; valid ones have an extent and lie within it."""
    x = V.boxes(spark, sf_dir).withColumn("b", F.when(F.col("id") % 11 == 0, F.col("t") - 1).otherwise(F.col("b")))
    x = x.withColumn("h", F.max("b").over(Window.partitionBy("page")))
    valid = F.coalesce(F.expr("l < r AND t < b AND l >= 0 AND h - b >= 0 AND h > 0"), F.lit(False))
    return x.select("id", "l", "r", (F.col("h") - F.col("b")).alias("t"), (F.col("h") - F.col("t")).alias("b"), valid.alias("valid"))


@query(sql("SELECT id, greatest(0, l - 2) AS l, greatest(0, t - 2) AS t, least(600, r + 2) AS r, least(700, b + 2) AS b FROM v_boxes", "v_boxes"))
def clip_box(spark, sf_dir):
    """Two points wider, within the page."""
    return V.boxes(spark, sf_dir).select("id", F.greatest(F.lit(0), F.col("l") - 2).alias("l"), F.greatest(F.lit(0), F.col("t") - 2).alias("t"), F.least(F.lit(600), F.col("r") + 2).alias("r"), F.least(F.lit(700), F.col("b") + 2).alias("b"))


@query(sql("SELECT text, page, count(DISTINCT l || ',' || t) AS boxes FROM v_boxes GROUP BY 1, 2 HAVING count(DISTINCT l || ',' || t) > 1", "v_boxes"))
def bbox_conflicts(spark, sf_dir):
    """Items with more than one box on a page."""
    return V.boxes(spark, sf_dir).groupBy("text", "page").agg(F.count_distinct("l", "t").alias("boxes")).where("boxes > 1")


SPANNED = "SELECT tab, row, col, text, row + CASE WHEN col = 0 AND row % 4 = 1 THEN 1 ELSE 0 END AS to_row, col + CASE WHEN col = 1 AND row % 3 = 1 THEN 1 ELSE 0 END AS to_col FROM v_cells WHERE NOT (col = 3 AND row % 5 = 2)"


@query(sql(f"""SELECT g.tab, g.row, g.col, coalesce(c.text, '') AS text, coalesce(c.cells, 0) AS cells, coalesce(c.texts, 0) > 1 AS conflict FROM (SELECT tab, row, unnest(range(n_cols))::INT AS col FROM (SELECT tab, unnest(range(max(to_row) + 1))::INT AS row, max(to_col) + 1 AS n_cols FROM ({SPANNED}) GROUP BY 1)) g
LEFT JOIN (SELECT tab, r AS row, c AS col, arg_min(text, row * 1000 + col) AS text, count(*) AS cells, count(DISTINCT text) AS texts FROM (SELECT *, unnest(generate_series(col, to_col)) AS c FROM (SELECT *, unnest(generate_series(row, to_row)) AS r FROM ({SPANNED}))) GROUP BY 1, 2, 3) c ON c.tab = g.tab AND c.row = g.row AND c.col = g.col""", *CELLS))
def grid_expand(spark, sf_dir):
    """A full grid of a table's rows and columns, merged cells in each of their places; places without a cell are empty.

    Where cells meet, the one that begins first stands, and a conflict is marked if their texts differ. One shuffle, by table."""
    row, col = F.col("row"), F.col("col")
    c = V.cells(spark, sf_dir).where("NOT (col = 3 AND row % 5 = 2)").repartition("tab")
    rows = F.sequence(row, row + F.when((col == 0) & (row % 4 == 1), 1).otherwise(0))
    cols = F.sequence(col, col + F.when((col == 1) & (row % 3 == 1), 1).otherwise(0))
    places = c.select("tab", "row", "col", "text", F.explode(rows).alias("r"), cols.alias("cs")).select("tab", "row", "col", "text", "r", F.explode("cs").alias("c"))
    each = places.groupBy("tab", "r", "c").agg(F.min_by("text", F.struct("row", "col")).alias("text"), F.count(F.lit(1)).alias("cells"), (F.min("text") != F.max("text")).alias("conflict"))
    whole = each.groupBy("tab").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("r", "c"), F.struct("text", "cells", "conflict")))).alias("m"), F.max("r").alias("rs"), F.max("c").alias("cs"))
    grid = whole.select("tab", "m", "cs", F.explode(F.sequence(F.lit(0), F.col("rs"))).alias("row")).select("tab", "m", "row", F.explode(F.sequence(F.lit(0), F.col("cs"))).alias("col"))
    at = F.try_element_at("m", F.struct(F.col("row").alias("r"), F.col("col").alias("c")))
    return grid.select("tab", "row", "col", at.alias("x")).select("tab", "row", "col", F.coalesce("x.text", F.lit("")).alias("text"), F.coalesce("x.cells", F.lit(0)).cast("long").alias("cells"), F.coalesce("x.conflict", F.lit(False)).alias("conflict"))


# ---- vectors -----------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector over its length; null for one without."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x / n))


@query("SELECT vec_id, len(embedding) AS dims, len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: (isnan(x) OR isinf(x))::INT)) = 0 AS valid FROM embeddings")
def embedding_checks(spark, sf_dir):
    bad = F.exists("embedding", lambda x: F.isnan(x) | x.isNull() | (F.abs(x) == float("inf")))
    return V.table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("dims"), ((F.size("embedding") == 64) & ~bad).alias("valid"))


@query("SELECT vec_id, n > 0 AS valid, CASE WHEN n > 0 THEN array_to_string(list_transform(embedding, lambda x: round(x::DOUBLE / n * 100000)::BIGINT), ',') END AS unit FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)")
def l2_normalize(spark, sf_dir):
    """Each vector over its length, in whole hundred thousandths; one without a length is rejected."""
    e = V.table(spark, sf_dir, "embeddings").withColumn("u", unit(F.col("embedding")))
    return e.select("vec_id", F.col("u").isNotNull().alias("valid"), F.array_join(F.transform("u", lambda x: F.round(x * 100000).cast("long").cast("string")), ",").alias("unit"))


COSINE = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))"
#: Candidates that each query keeps: the feature of a search.
POOL = 20
NEAR = f"SELECT * FROM (SELECT a.vec_id AS query_id, b.vec_id, round({COSINE}, 5) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) <= {POOL}"
#: Queries and rows of a block.
QUERY_BLOCK, ROW_BLOCK = 4096, 65_536
#: The same where a block's product is taken in tiles: more queries, so that rows are copied for fewer blocks.
TILED_QUERIES, TILED_ROWS, TILE = 16_384, 32_768, 128


def blocks_of(asked: DataFrame, rows: DataFrame, by: str, queries: int | None = None, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """asked and rows once for each pair of blocks (q, r) that they take part in: blocks of the hash of column `by`."""
    n_q, n_r = -(-asked.count() // (queries or QUERY_BLOCK)) or 1, -(-rows.count() // (most or ROW_BLOCK)) or 1
    place = lambda n: F.pmod(F.xxhash64(by), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda df: [F.col(c).alias(c) for c in df.columns]  # noqa: E731  columns of their own, as both may come from one table
    return asked.select(*own(asked), place(n_q).alias("q"), every(n_r).alias("r")), rows.select(*own(rows), place(n_r).alias("r"), every(n_q).alias("q"))


_FOUND: dict[tuple, DataFrame] = {}


def near_pairs(spark, sf_dir) -> DataFrame:
    """Every fiftieth vector with its POOL nearest of all vectors, ties to smaller ids, and their cosine to five places.

    Written once for each state of the table's files in an application, as many queries begin with it; anew where the shared folder was cleared since."""
    files = V.table(spark, sf_dir, "embeddings").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    state = tuple(files.agg(F.bit_xor(F.xxhash64("*")), F.count(F.lit(1))).first())  # a sum of hashes overflows where there are several files
    key = (spark.sparkContext.applicationId, sf_dir, state)
    if key not in _FOUND or not still_there(_FOUND[key]):
        _FOUND[key] = settled(nearest_pairs(spark, sf_dir))
    return _FOUND[key]


def nearest_pairs(spark, sf_dir) -> DataFrame:
    """What near_pairs() writes. Blocks of queries meet blocks of rows; each keeps its best, and these are merged. Vectors without a length take no part.

    A tile's product of unit vectors only says which rows can be among the best; their cosine is then taken as the SQL takes it."""
    e = V.table(spark, sf_dir, "embeddings").where((dot(F.col("embedding"), F.col("embedding")) > 0) & F.col("vec_id").isNotNull()).select("vec_id", "embedding")
    asked, rows = blocks_of(e.where("vec_id % 50 = 0"), e, "vec_id", TILED_QUERIES, TILED_ROWS)
    tile = TILE

    def best(asks, have):
        import numpy as np
        import pandas as pd

        names, kept = ("query_id", "vec_id", "cosine"), []
        if len(asks) and len(have):
            have = have.sort_values("vec_id")
            ids, x, y = have["vec_id"].to_numpy(), *(np.stack(v["embedding"]).astype("float64") for v in (have, asks))
            queries, most = asks["vec_id"].to_numpy(), min(POOL + 1, len(ids))  # one more, for the query itself
            xx, yy = (np.einsum("ij,ij->i", v, v) for v in (x, y))
            unit_x, unit_y = x / np.sqrt(xx)[:, None], y / np.sqrt(yy)[:, None]
            for at in range(0, len(queries), tile):
                like = unit_y[at : at + tile] @ unit_x.T
                least = np.partition(like, -most, axis=1)[:, -most] - 2e-5  # twice the last place; NaN counts as the largest, as in SQL
                for i, row in enumerate(~(like < least[:, None]), at):
                    able = np.flatnonzero(row)
                    cosine = np.round((x[able] @ y[i]) / np.sqrt(xx[able] * yy[i]), 5)
                    order = np.lexsort((able, np.where(np.isnan(cosine), -np.inf, -cosine)))[:most]
                    kept.append((np.full(len(order), queries[i]), ids[able[order]], cosine[order]))
        found = pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*kept, strict=True)), strict=True)) if kept else {n: [] for n in names})
        return found[found["query_id"] != found["vec_id"]].astype({"query_id": "int64", "vec_id": "int64", "cosine": "float64"})

    found = asked.groupBy("q", "r").cogroup(rows.groupBy("q", "r")).applyInPandas(best, "query_id long, vec_id long, cosine double")
    found = found.withColumn("cosine", F.coalesce("cosine", F.lit(float("nan"))))  # which pandas hands over as null
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= POOL).drop("place")


@query(f"SELECT query_id, vec_id, cosine FROM ({NEAR})")
def cosine_pairs(spark, sf_dir):
    return near_pairs(spark, sf_dir)


@query(f"SELECT query_id, vec_id, k FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS k FROM ({NEAR})) WHERE k <= 5")
def vector_topk(spark, sf_dir):
    """The five nearest of all, ties to smaller ids."""
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return near_pairs(spark, sf_dir).withColumn("k", F.row_number().over(w)).where("k <= 5").select("query_id", "vec_id", "k")


#: How far apart two ids' places and sections are; a section is a number of two parts, a row one of four.
PLACES = "least(3::DOUBLE, 3::DOUBLE * abs(query_id % 1000 / 1000.0::DOUBLE - vec_id % 1000 / 1000.0::DOUBLE))"
SECTIONS = "least(0.3::DOUBLE, 0.05::DOUBLE * (abs(query_id % 4 - vec_id % 4) + abs(query_id % 7 - vec_id % 7)))"
SCORED = f"SELECT query_id, vec_id, cosine, {PLACES} AS place_penalty, round(cosine - {SECTIONS} - {PLACES} + CASE WHEN query_id % 4 = vec_id % 4 THEN 0.2::DOUBLE ELSE 0::DOUBLE END, 5) AS score FROM ({NEAR})"


def scored_pairs(spark, sf_dir) -> DataFrame:
    """Cosine less penalties for section and position, plus a bonus for equal row numbers."""
    q, v = F.col("query_id"), F.col("vec_id")
    section = lambda x: F.concat_ws(".", x % 4 + 1, x % 7)
    place = lambda x: (x % 1000 / F.lit(1000.0)).cast("string")
    near = near_pairs(spark, sf_dir).withColumn("place_penalty", R.position_penalty(place(q), place(v)))
    score = F.col("cosine") - R.section_penalty(section(q), section(v)) - F.col("place_penalty") + F.when(q % 4 == v % 4, 0.2).otherwise(0.0)
    return near.withColumn("score", F.round(score, 5))


@query(f"SELECT query_id, vec_id, score FROM ({SCORED})")
def candidate_score(spark, sf_dir):
    return scored_pairs(spark, sf_dir).select("query_id", "vec_id", "score")


#: A heading below SHORT characters with a margin up to its bound has a second choice; so has a row of equal numbers.
SHORT, HEADING_MARGIN, ROW_MARGIN = 24, 0.12, 0.03


@query(f"""SELECT query_id, best, margin, coalesce(k2 IS NOT NULL AND ((n < {SHORT} AND margin <= {HEADING_MARGIN}::DOUBLE) OR (query_id % 4 = k2 % 4 AND margin <= {ROW_MARGIN}::DOUBLE)), false) AS second_choice FROM (
SELECT query_id, max(score) AS best, round(max(score) - coalesce(max(score) FILTER (WHERE k = 2), -9::DOUBLE), 5) AS margin, max(vec_id) FILTER (WHERE k = 2) AS k2 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM ({SCORED})) GROUP BY 1)
LEFT JOIN (SELECT doc_id, length(split_part(text, chr(10), 1)) AS n FROM documents) ON doc_id = query_id""")  # fmt: skip
def candidate_margin(spark, sf_dir):
    """How far the best candidate is before the second, and whether the second stays a choice: by a short heading, or a row of equal numbers."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = scored_pairs(spark, sf_dir).withColumn("k", F.row_number().over(w)).where("k <= 2")
    second = lambda c: F.max(F.when(F.col("k") == 2, F.col(c)))
    g = ranked.groupBy("query_id").agg(F.max("score").alias("best"), F.round(F.max("score") - F.coalesce(second("score"), F.lit(-9.0)), 5).alias("margin"), second("vec_id").alias("k2"))
    heads = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.length(F.substring_index("text", "\n", 1)).alias("n"))
    short = F.coalesce((F.col("n") < SHORT) & (F.col("margin") <= HEADING_MARGIN), F.lit(False))
    equal = F.coalesce((F.col("query_id") % 4 == F.col("k2") % 4) & (F.col("margin") <= ROW_MARGIN), F.lit(False))
    return g.join(heads, "query_id", "left").select("query_id", "best", "margin", (F.col("k2").isNotNull() & (short | equal)).alias("second_choice"))


#: Candidates kept of each class: cells, the query's own label, other labels.
CLASSES = {"cell": 2, "same": 8, "cross": 16}


@query(f"""SELECT query_id, vec_id, class, k FROM (SELECT *, row_number() OVER (PARTITION BY query_id, class ORDER BY score DESC, vec_id) AS k FROM (
SELECT s.query_id, s.vec_id, s.score, CASE WHEN s.vec_id % 5 = 4 THEN 'cell' WHEN a.label IS NOT DISTINCT FROM b.label THEN 'same' ELSE 'cross' END AS class FROM ({SCORED}) s JOIN embeddings a ON a.vec_id = s.query_id JOIN embeddings b ON b.vec_id = s.vec_id))
WHERE k <= CASE class WHEN 'cell' THEN 2 WHEN 'same' THEN 8 ELSE 16 END""")  # fmt: skip
def rerank_classes(spark, sf_dir):
    """The pool to rank anew: at most two cells, eight candidates of the query's label and sixteen of others."""
    e = V.table(spark, sf_dir, "embeddings")
    own, other = (e.select(F.col("vec_id").alias(i), F.col("label").alias(n)) for i, n in (("query_id", "own"), ("vec_id", "other")))
    s = scored_pairs(spark, sf_dir).join(own, "query_id").join(other, "vec_id")
    s = s.withColumn("class", F.when(F.col("vec_id") % 5 == 4, "cell").when(F.col("own").eqNullSafe(F.col("other")), "same").otherwise("cross"))
    most = F.try_element_at(F.create_map(*[F.lit(x) for pair in CLASSES.items() for x in pair]), F.col("class"))
    w = Window.partitionBy("query_id", "class").orderBy(F.desc("score"), "vec_id")
    return s.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).select("query_id", "vec_id", "class", "k")


@query(f"SELECT a.query_id, a.vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM ({SCORED})) a JOIN (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, query_id) AS k FROM ({SCORED})) b ON a.query_id = b.query_id AND a.vec_id = b.vec_id AND a.k = 1 AND b.k = 1")
def mutual_best(spark, sf_dir):
    """Pairs that are each other's best."""
    s = scored_pairs(spark, sf_dir)
    best = lambda by, other: Window.partitionBy(by).orderBy(F.desc("score"), other)
    both = s.withColumn("k", F.row_number().over(best("query_id", "vec_id"))).withColumn("k2", F.row_number().over(best("vec_id", "query_id")))
    return both.where("k = 1 AND k2 = 1").select("query_id", "vec_id")


def mean_of(hundred_thousandths: Column, n: Column) -> Column:
    """A mean to six places from whole hundred thousandths: sums of whole numbers don't depend on their order."""
    return F.floor((hundred_thousandths * 20 + n) / (2 * n)) / 1000000


#: From what likeness on a neighbour is evidence; the best score and its place's penalty that a front page must not have.
EVIDENCE_LIKE, GATE_PENALTY, GATE_SCORE = 0.69, 0.10, 0.60


@query(f"SELECT query_id, vec_id, NOT (place_penalty >= {GATE_PENALTY}::DOUBLE AND score < {GATE_SCORE}::DOUBLE) AS passes FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM ({SCORED})) WHERE k = 1")
def front_page_gate(spark, sf_dir):
    """Each query's best candidate, and whether it passes: not far away in place and low in score."""
    best = scored_pairs(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where("k = 1")
    return best.select("query_id", "vec_id", (~((F.col("place_penalty") >= GATE_PENALTY) & (F.col("score") < GATE_SCORE))).alias("passes"))


@query(f"SELECT query_id, string_agg(vec_id::VARCHAR, ',' ORDER BY k) AS refs FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS k FROM ({NEAR})) WHERE k <= 5 GROUP BY 1")
def rag_context(spark, sf_dir):
    """The references that go with a query, nearest first."""
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    top = near_pairs(spark, sf_dir).withColumn("k", F.row_number().over(w)).where("k <= 5")
    return top.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "vec_id"))), lambda x: x["vec_id"].cast("string")), ",").alias("refs"))


@query(sql("""SELECT tab, row, col, concat_ws(' ', text, CASE WHEN col > 0 THEN first END, CASE WHEN row > 0 THEN head END, siblings, above, below) AS search FROM (
SELECT c.*, first_value(text) OVER (PARTITION BY tab, row ORDER BY col) AS first, max(CASE WHEN header THEN text END) OVER (PARTITION BY tab, col) AS head FROM v_cells c)
LEFT JOIN (SELECT a.tab, a.row, a.col, string_agg(b.text, ' | ' ORDER BY b.col) AS siblings FROM v_cells a JOIN v_cells b ON a.tab = b.tab AND a.row = b.row AND a.col <> b.col AND b.text <> '' GROUP BY 1, 2, 3) USING (tab, row, col)
LEFT JOIN (SELECT tab, row, CASE WHEN NOT lag(header) OVER w THEN lag(text) OVER w END AS above, lead(text) OVER w AS below FROM v_cells WHERE col = 0 WINDOW w AS (PARTITION BY tab ORDER BY row)) USING (tab, row) WHERE text <> ''""", *CELLS))  # fmt: skip
def search_text(spark, sf_dir):
    """A cell's text with its row's and its column's label, the other cells of its row and the labels of the rows around. One shuffle, by table."""
    c = V.cells(spark, sf_dir).repartition("tab")
    heads = F.max(F.when(F.col("header"), F.col("text"))).over(Window.partitionBy("tab", "col"))
    rows = c.withColumn("head", heads).groupBy("tab", "row").agg(F.sort_array(F.collect_list(F.struct("col", "text", "head"))).alias("all"), F.bool_or("header").alias("header"))
    w, label = Window.partitionBy("tab").orderBy("row"), F.get("all", F.lit(0))["text"]
    rows = rows.withColumn("above", F.when(~F.lag("header").over(w), F.lag(label).over(w))).withColumn("below", F.lead(label).over(w))
    each = rows.select("tab", "row", "all", "above", "below", label.alias("first"), F.explode("all").alias("me")).where("me.text <> ''")
    others = F.filter("all", lambda x: (x["col"] != F.col("me.col")) & (x["text"] != ""))
    siblings = F.when(F.size(others) > 0, F.array_join(F.transform(others, lambda x: x["text"]), " | "))
    search = F.concat_ws(" ", "me.text", F.when(F.col("me.col") > 0, F.col("first")), F.when(F.col("row") > 0, F.col("me.head")), siblings, "above", "below")
    return each.select("tab", "row", F.col("me.col").alias("col"), search.alias("search"))


# ---- ordered folds -----------------------------------------------------------------------------


def packed(items: Column, size, budget: int, most: int) -> Column:
    """Batches of items in order: each at most `most` items and `budget` by size(item); a larger item alone.

    items: array of structs with `ord`; gives an array of (batch, ord)."""
    numbers = by_row(lambda sizes: batch_numbers(sizes, budget, most), "array<int>")
    return F.zip_with(items, numbers(F.transform(items, size)), lambda x, b: F.struct(b.alias("batch"), x["ord"].cast("int").alias("ord")))


def batches(df: DataFrame, budget: int, most: int) -> DataFrame:
    """(doc_id, batch, first, units) of units packed in order."""
    g = df.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.col("ord").cast("int").alias("ord"), F.octet_length("text").alias("n")))).alias("u"))
    each = g.select("doc_id", F.explode(packed(F.col("u"), lambda x: x["n"], budget, most)).alias("b"))
    return each.groupBy("doc_id", F.col("b.batch").alias("batch")).agg(F.min("b.ord").alias("first"), F.count(F.lit(1)).alias("units"))


@query("""WITH RECURSIVE v_lines AS (%s), v_units AS (%s), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k, strlen(text) AS size FROM v_units),
f(doc_id, k, ord, batch, used, c) AS (SELECT doc_id, k, ord, 0, size, 1 FROM n WHERE k = 1 UNION ALL
SELECT n.doc_id, n.k, n.ord, f.batch + CASE WHEN f.used + n.size > 1500 OR f.c >= 64 THEN 1 ELSE 0 END, CASE WHEN f.used + n.size > 1500 OR f.c >= 64 THEN n.size ELSE f.used + n.size END, CASE WHEN f.used + n.size > 1500 OR f.c >= 64 THEN 1 ELSE f.c + 1 END FROM f JOIN n ON n.doc_id = f.doc_id AND n.k = f.k + 1)
SELECT doc_id, batch, min(ord) AS first, count(*) AS units FROM f GROUP BY 1, 2""" % (V.SQL["v_lines"], V.SQL["v_units"]))  # fmt: skip
def unit_batches(spark, sf_dir):
    """Units kept whole in batches of at most 64 and 1,500 bytes."""
    return batches(V.units(spark, sf_dir), 1500, 64)


def pieces(units: DataFrame, spans: DataFrame, budget: int) -> DataFrame:
    """(doc_id, ord, piece, bytes, spans, oversize): units within the budget whole (piece 0), larger ones cut at spans.

    A single span over the budget is a piece of its own, and marked: no cut keeps it within."""
    small = units.where(F.octet_length("text") <= budget).select("doc_id", "ord", F.lit(0).alias("piece"), F.octet_length("text").cast("long").alias("bytes"), F.lit(0).cast("long").alias("spans"))
    large = units.where(F.octet_length("text") > budget).select("unit_id", "doc_id", "ord")
    s = spans.select("unit_id", "span_ord", F.octet_length("source").alias("n")).join(large, "unit_id")
    g = s.groupBy("doc_id", "ord").agg(F.sort_array(F.collect_list(F.struct(F.col("span_ord").cast("int").alias("ord"), "n"))).alias("u"))
    each = g.select("doc_id", "ord", F.explode(F.zip_with("u", packed(F.col("u"), lambda x: x["n"], budget, 1 << 30), lambda x, y: F.struct(y["batch"].alias("piece"), x["n"].alias("n")))).alias("p"))
    cut = each.groupBy("doc_id", "ord", F.col("p.piece").alias("piece")).agg(F.sum("p.n").alias("bytes"), F.count(F.lit(1)).alias("spans"))
    return small.unionByName(cut).withColumn("oversize", F.col("bytes") > budget)


@query()
def unit_pieces(spark, sf_dir):
    """Units in pieces of at most 600 bytes."""
    return pieces(V.units(spark, sf_dir), V.spans(spark, sf_dir), 600)


@query()
def piece_batches(spark, sf_dir):
    """Pieces of units in batches of at most 64 and 1,500 bytes, in order; none is over budget but for a single oversize span."""
    p = pieces(V.units(spark, sf_dir), V.spans(spark, sf_dir), 1500)
    g = p.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "piece", F.col("bytes").alias("n")))).alias("s"))
    u = F.transform("s", lambda x, i: F.struct(i.alias("ord"), x["n"].alias("n")))
    each = g.select("doc_id", F.explode(F.zip_with("s", packed(u, lambda x: x["n"], 1500, 64), lambda x, y: F.struct(y["batch"].alias("batch"), x["n"].alias("n")))).alias("b"))
    return each.groupBy("doc_id", F.col("b.batch").alias("batch")).agg(F.count(F.lit(1)).alias("pieces"), F.sum("b.n").alias("bytes"))


@query(sql("SELECT unit_id, max(used)::BIGINT AS bytes FROM (SELECT unit_id, sum(strlen(source)) OVER (PARTITION BY unit_id ORDER BY span_ord ROWS UNBOUNDED PRECEDING) AS used FROM v_spans) WHERE used <= 200 GROUP BY 1", *SPANS))
def sentence_prefix(spark, sf_dir):
    """The longest run of whole sentences from the start within 200 bytes."""
    used = F.sum(F.octet_length("source")).over(Window.partitionBy("unit_id").orderBy("span_ord").rowsBetween(Window.unboundedPreceding, 0))
    return V.spans(spark, sf_dir).select("unit_id", used.alias("used")).where("used <= 200").groupBy("unit_id").agg(F.max("used").alias("bytes"))


@query(sql("SELECT doc_id, half, count(*) AS units FROM (SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY doc_id ORDER BY ord) <= (count(*) OVER (PARTITION BY doc_id) + 1) // 2 THEN 0 ELSE 1 END AS half FROM v_units) GROUP BY 1, 2", *UNITS))
def halving(spark, sf_dir):
    """A batch to retry as two halves."""
    k, n = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")), F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    return V.units(spark, sf_dir).select("doc_id", F.when(k <= F.floor((n + 1) / 2), 0).otherwise(1).alias("half")).groupBy("doc_id", "half").agg(F.count(F.lit(1)).alias("units"))


@query()
def rag_chunks(spark, sf_dir):
    """Chunks of at most 1,000 characters with up to 100 of overlap, cut at paragraphs, then sentences, then spaces."""
    text = F.col("text")
    chunk = by_row(chunks_of, "array<string>")
    d = V.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunk(text)).alias("chunk", "content"))
    return d.select("doc_id", "chunk", "content", F.sha2("content", 256).alias("content_sha256"))


@query()
def sentence_split(spark, sf_dir):
    """Sentences of a document; put together they are its text again."""
    return V.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(by_row(sentences_of, "array<string>")("text")).alias("k", "sentence"))


@query(sql("SELECT o_custkey AS chain, tab, sum(n) OVER (PARTITION BY o_custkey ORDER BY tab ROWS UNBOUNDED PRECEDING)::BIGINT - n AS row_offset FROM (SELECT tab, max(row) AS n FROM v_cells GROUP BY 1) JOIN orders ON o_orderkey = tab", *CELLS))
def table_merge(spark, sf_dir):
    """Tables of a chain appended: where each one's rows begin."""
    n = V.cells(spark, sf_dir).groupBy("tab").agg(F.max("row").alias("n"))
    o = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tab"), F.col("o_custkey").alias("chain"))
    before = F.sum("n").over(Window.partitionBy("chain").orderBy("tab").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return n.join(o, "tab").select("chain", "tab", before.alias("row_offset"))


@query(sql("SELECT unit_id, count(*) AS pieces, count(DISTINCT split_part(source, ' ', 1)) AS heads FROM v_spans GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT split_part(source, ' ', 1)) = count(*)", *SPANS))
def split_heading_nodes(spark, sf_dir):
    """Units to split: several pieces, all with different heads."""
    g = V.spans(spark, sf_dir).groupBy("unit_id").agg(F.count(F.lit(1)).alias("pieces"), F.count_distinct(F.split("source", " ")[0]).alias("heads"))
    return g.where("pieces > 1 AND heads = pieces")


@query(sql("SELECT span_id, substr(source, greatest(1, (30 - before + 1)::INT)) AS text FROM (SELECT span_id, source, (sum(length(source)) OVER (PARTITION BY unit_id ORDER BY span_ord ROWS UNBOUNDED PRECEDING) - length(source))::BIGINT AS before FROM v_spans)", *SPANS))
def strip_prefix_spans(spark, sf_dir):
    """The first 30 characters of a unit taken off its spans."""
    before = F.sum(F.length("source")).over(Window.partitionBy("unit_id").orderBy("span_ord").rowsBetween(Window.unboundedPreceding, 0)) - F.length("source")
    return V.spans(spark, sf_dir).select("span_id", "source", before.alias("before")).select("span_id", F.expr("substr(source, greatest(1, cast(30 - before + 1 as int)))").alias("text"))


# ---- sets and versions -------------------------------------------------------------------------


@query(sql("SELECT 'p' || (doc_id % 5) AS part, doc_id, row_number() OVER (ORDER BY doc_id % 5, doc_id) - 1 AS new_index FROM documents", "v_lines"))
def merge_parts(spark, sf_dir):
    """Parts put together: each part's rows follow those of the parts before it."""
    d = V.table(spark, sf_dir, "documents").select((F.col("doc_id") % 5).alias("p"), "doc_id", F.floor(F.col("doc_id") / 100_000).alias("range"))
    sizes = d.groupBy("p", "range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("p", "range", (F.sum("n").over(Window.orderBy("p", "range")) - F.col("n")).alias("before"))
    k = F.row_number().over(Window.partitionBy("p", "range").orderBy("doc_id")) - 1
    return d.withColumn("k", k).join(before, ["p", "range"]).select(F.concat(F.lit("p"), "p").alias("part"), "doc_id", (F.col("before") + F.col("k")).alias("new_index"))


@query(sql("SELECT doc_id, count(*) FILTER (WHERE n <> 1) AS wrong, count(*) AS ids FROM (SELECT doc_id, unit_id, count(*) AS n FROM (SELECT doc_id, unit_id FROM v_units UNION ALL SELECT doc_id, unit_id FROM v_v2 WHERE ord % 9 = 0) GROUP BY 1, 2) GROUP BY 1", *UNITS, "v_v2"))
def coverage_check(spark, sf_dir):
    """Ids that aren't covered exactly once."""
    ids = V.units(spark, sf_dir).select("doc_id", "unit_id").unionByName(V.version2(spark, sf_dir).where("ord % 9 = 0").select("doc_id", "unit_id"))
    return ids.groupBy("doc_id", "unit_id").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg(F.count_if(F.col("n") != 1).alias("wrong"), F.count(F.lit(1)).alias("ids"))


@query(sql("SELECT unit_id, 'old' AS origin FROM v_units WHERE ord % 2 = 0 AND unit_id NOT IN (SELECT unit_id FROM v_v2 WHERE ord % 3 = 0) UNION ALL SELECT unit_id, 'new' FROM v_v2 WHERE ord % 3 = 0", *UNITS, "v_v2"))
def replace_by_key(spark, sf_dir):
    """Old rows but for keys that come anew, and the new ones."""
    new = V.version2(spark, sf_dir).where("ord % 3 = 0").select("unit_id")
    old = V.units(spark, sf_dir).where("ord % 2 = 0").select("unit_id").join(new, "unit_id", "left_anti")
    return old.withColumn("origin", F.lit("old")).unionByName(new.withColumn("origin", F.lit("new")))


@query(sql("SELECT doc_id, string_agg(ord::VARCHAR, ',' ORDER BY ord) AS ords FROM v_units WHERE unit_id NOT IN (SELECT unit_id FROM v_v2 WHERE ord % 2 = 1) GROUP BY 1", *UNITS, "v_v2"))
def regroup_unmatched(spark, sf_dir):
    """Groups without the ids that are searched again; empty ones are gone."""
    groups = V.units(spark, sf_dir).groupBy("doc_id").agg(F.collect_list("ord").alias("a"))
    again = V.version2(spark, sf_dir).where("ord % 2 = 1").groupBy("doc_id").agg(F.collect_list("ord").alias("b"))
    left = F.array_except("a", F.coalesce("b", F.array().cast("array<int>")))
    return groups.join(again, "doc_id", "left").select("doc_id", F.array_sort(left).alias("x")).where(F.size("x") > 0).select("doc_id", F.array_join(F.transform("x", lambda v: v.cast("string")), ",").alias("ords"))


@query(sql("SELECT id, 'kept' AS state FROM v_points o WHERE id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM v_points n WHERE n.id % 2 = 1 AND n.logical_path = o.logical_path AND n.source_key <> o.source_key) AND NOT EXISTS (SELECT 1 FROM v_points n WHERE n.id % 2 = 1 AND n.source_key = o.source_key AND n.revision <> o.revision) UNION ALL SELECT id, 'inserted' FROM v_points WHERE id % 2 = 1", "v_points"))
def vector_upsert(spark, sf_dir):
    """New points are inserted; old ones of their path by another source, or of their source in another revision, go."""
    p = V.points(spark, sf_dir)
    old, new = p.where("id % 2 = 0"), p.where("id % 2 = 1")
    ends = lambda by, c: new.groupBy(by).agg(F.min(c).alias(f"{c}_low"), F.max(c).alias(f"{c}_high"))
    kept = old.join(ends("logical_path", "source_key"), "logical_path", "left").join(ends("source_key", "revision"), "source_key", "left")
    other = lambda c: F.coalesce((F.col(f"{c}_low") != F.col(c)) | (F.col(f"{c}_high") != F.col(c)), F.lit(False))  # noqa: E731  one value other than c is the least or the largest
    kept = kept.where(~other("source_key") & ~other("revision")).select("id", F.lit("kept").alias("state"))
    return kept.unionByName(new.select("id", F.lit("inserted").alias("state")))


def versions(spark, sf_dir) -> DataFrame:
    """(doc_id, a, b): the ordered texts of both versions."""
    texts = lambda df, name: df.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias(name))
    return texts(V.units(spark, sf_dir), "a").join(texts(V.version2(spark, sf_dir), "b"), "doc_id")


def matching_places(a, b):
    """Places of equal runs of two lists, as pairs."""
    m = difflib.SequenceMatcher(None, list(a), list(b), autojunk=False)
    return [(x.a + i, x.b + i) for x in m.get_matching_blocks() for i in range(x.size)]


@query()
def identical_units(spark, sf_dir):
    """Units that two versions share in order."""
    pairs = by_row(matching_places, "array<struct<old:int,new:int>>")
    return versions(spark, sf_dir).select("doc_id", F.explode(pairs("a", "b")).alias("p")).select("doc_id", "p.old", "p.new")


#: Least characters of a front page, and from what likeness on it is a copy.
FRONT_CHARS, FRONT_LIKE = 100, 0.85


def first_page_text(units: DataFrame, name: str) -> DataFrame:
    page = units.where(F.floor(F.col("ord") / 10) == 0).groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("t"))
    return page.select("doc_id", F.trim(F.regexp_replace(F.lower(F.array_join("t", " ")), r"\s+", " ")).alias(name))


@query()
def front_page_copy(spark, sf_dir):
    """How like the first pages of two versions are, and whether one copies the other.

    All units of page 1, in order, put together, white space and case folded; both are long enough, and hardly any sign of the later one is
    Japanese."""
    a, b = first_page_text(V.units(spark, sf_dir), "a"), first_page_text(V.version2(spark, sf_dir), "b")
    both = a.join(b, "doc_id").where(F.least(F.length("a"), F.length("b")) >= FRONT_CHARS)
    japanese = F.length(F.regexp_replace("b", "[^\u3040-\u30ff\u4e00-\u9fff]", ""))
    like = by_row(lambda x, y: difflib.SequenceMatcher(None, x, y).ratio(), "double")
    both = both.where(japanese * 100 <= F.length("b")).select("doc_id", like("a", "b").alias("r"))
    return both.select("doc_id", F.round("r", 6).alias("ratio"), (F.col("r") >= FRONT_LIKE).alias("copied"))


@query()
def line_diff(spark, sf_dir):
    """The unified difference of two versions."""
    lines = by_row(lambda a, b: list(difflib.unified_diff(list(a), list(b), lineterm="", n=0))[2:], "array<string>")
    return versions(spark, sf_dir).select("doc_id", F.posexplode(lines("a", "b")).alias("k", "line"))


CHANGE = "SELECT coalesce(a.unit_id, b.unit_id) AS unit_id, CASE WHEN b.unit_id IS NULL THEN 'deleted' WHEN a.unit_id IS NULL THEN 'added' WHEN a.text = b.text THEN 'unchanged' ELSE 'changed' END AS kind FROM v_units a FULL JOIN v_v2 b USING (unit_id)"


def changes(spark, sf_dir) -> DataFrame:
    a = V.units(spark, sf_dir).select("unit_id", F.col("text").alias("a"), "doc_id", "ord")
    b = V.version2(spark, sf_dir).select("unit_id", F.col("text").alias("b"))
    kind = F.when(F.col("b").isNull(), "deleted").when(F.col("a").isNull(), "added").when(F.col("a") == F.col("b"), "unchanged").otherwise("changed")
    return a.join(b, "unit_id", "full_outer").withColumn("kind", kind)


@query(sql(CHANGE, *UNITS, "v_v2"))
def change_kinds(spark, sf_dir):
    return changes(spark, sf_dir).select("unit_id", "kind")


@query(sql(f"SELECT unit_id, kind FROM ({CHANGE}) WHERE kind IN ('deleted', 'added')", *UNITS, "v_v2"))
def one_sided_changes(spark, sf_dir):
    """What only one version has."""
    return changes(spark, sf_dir).where("kind IN ('deleted', 'added')").select("unit_id", "kind")


@query(sql(f"SELECT doc_id, string_agg(ord || ':' || c.kind, ',' ORDER BY ord) AS plan FROM ({CHANGE}) c JOIN v_units u USING (unit_id) WHERE c.kind <> 'unchanged' GROUP BY 1", *UNITS, "v_v2"))
def upgrade_plan(spark, sf_dir):
    """The changes of a document in its order, unchanged units left out."""
    c = changes(spark, sf_dir).where("kind <> 'unchanged' AND doc_id IS NOT NULL")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("ord", "kind"))), lambda x: F.concat_ws(":", x["ord"], x["kind"]))
    return c.groupBy("doc_id").agg(F.array_join(parts, ",").alias("plan"))
