"""Parts put together and cut apart: references and pages of merged parts, tables over several pages, nodes in place of one."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions.json_refs import refs_of, shifted
from quire.functions.text import by_row
from quire.plans.registry import query
from quire.sources import views as V
from quire.sources.views import SPANS, UNITS, sql

NUMBERED = "SELECT doc_id, doc_id % 5 AS part, sha, path, pages, row_number() OVER (ORDER BY doc_id % 5, doc_id) - 1 AS new_index, sum(pages) OVER (ORDER BY doc_id % 5, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT - pages AS page_before FROM v_files JOIN (SELECT doc_id, max(page)::BIGINT AS pages FROM v_units GROUP BY 1) USING (doc_id)"


@query(sql(f"SELECT doc_id, '#/texts/' || new_index AS ref, page_before + 1 AS first_page, printf('part-%04d/', part + 1) || replace(replace(path, '/', chr(92)), chr(92), '/') AS uri, ('0x' || right(sha, 16))::UBIGINT::VARCHAR AS origin FROM ({NUMBERED})", *UNITS, "v_files"))
def merge_rewrites(spark, sf_dir):
    """Parts put together: each item's new reference and first page, its asset within its part, and the hash of its origin modulo 2 ** 64.

    Numbers and pages run on in two steps (within ranges of ids, then the ranges' offsets), so no task holds all."""
    pages = V.units(spark, sf_dir).groupBy("doc_id").agg(F.max("page").cast("long").alias("pages"))
    d = V.files(spark, sf_dir).join(pages, "doc_id").select("doc_id", (F.col("doc_id") % 5).alias("part"), F.floor(F.col("doc_id") / 100_000).alias("range"), "sha", F.replace("path", F.lit("/"), F.lit("\\")).alias("path"), "pages")
    sizes = d.groupBy("part", "range").agg(F.count(F.lit(1)).alias("n"), F.sum("pages").alias("p"))
    by_range = Window.orderBy("part", "range")  # one row for each part and 100,000 ids
    before = sizes.select("part", "range", (F.sum("n").over(by_range) - F.col("n")).alias("n_before"), (F.sum("p").over(by_range) - F.col("p")).alias("p_before"))
    w = Window.partitionBy("part", "range").orderBy("doc_id")
    own = d.withColumn("k", F.row_number().over(w) - 1).withColumn("q", F.sum("pages").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("pages"))
    uri = F.concat(F.format_string("part-%04d/", F.col("part") + 1), F.replace("path", F.lit("\\"), F.lit("/")))
    return own.join(before, ["part", "range"]).select("doc_id", F.concat(F.lit("#/texts/"), F.col("n_before") + F.col("k")).alias("ref"), (F.col("p_before") + F.col("q") + 1).alias("first_page"), uri.alias("uri"), F.conv(F.right("sha", F.lit(16)), 16, 10).alias("origin"))


#: Text that looks like references, which a walker must leave alone.
DECOY = 'says "$ref": "#/texts/0" and \\ and {"$ref":"#/texts/1"}'


@query(sql(f"""SELECT doc_id, before, string_agg('#/texts/' || (before + k - 1), ',' ORDER BY '#/texts/' || (before + k - 1)) AS refs, sha256(string_agg('{DECOY}' || text, '|' ORDER BY k)) AS texts
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM v_units) JOIN (SELECT doc_id, sum(n) OVER (PARTITION BY doc_id // 5 ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT - n AS before FROM (SELECT doc_id, count(*) AS n FROM v_units GROUP BY 1)) USING (doc_id) GROUP BY doc_id, before""", *UNITS))
def refs_shifted(spark, sf_dir):
    """Documents as JSON parts of one document: their references, at any depth, moved on by the texts of the parts before, their texts untouched.

    Every fifth document begins a new whole; some parts are written with spaces and line ends."""
    u = V.units(spark, sf_dir).withColumn("text", F.concat(F.lit(DECOY), F.col("text"))).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("u"))
    own = lambda i: F.concat(F.lit("#/texts/"), i)
    body = F.struct(F.lit("#/body").alias("self_ref"), F.transform("u", lambda x, i: F.struct(own(i).alias("$ref"))).alias("children"))
    texts = F.transform("u", lambda x, i: F.struct(own(i).alias("self_ref"), x["text"].alias("text"), F.struct(F.array(F.struct(own(i).alias("$ref"))).alias("captions")).alias("data")))
    whole = F.struct(body.alias("body"), texts.alias("texts"))
    parts = u.select("doc_id", F.size("u").cast("long").alias("n"), F.when(F.col("doc_id") % 2 == 0, F.to_json(whole, {"pretty": "true"})).otherwise(F.to_json(whole)).alias("json"))
    w = Window.partitionBy(F.floor(F.col("doc_id") / 5)).orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = parts.withColumn("before", F.sum("n").over(w) - F.col("n"))
    moved = placed.withColumn("json", by_row(shifted, "string")("json", F.array(F.lit("texts")), F.array("before")))
    read = F.from_json("json", "texts array<struct<self_ref:string,text:string>>")
    return moved.select("doc_id", "before", F.array_join(by_row(refs_of, "array<string>")("json"), ",").alias("refs"), F.sha2(F.array_join(F.transform(read["texts"], lambda x: x["text"]), "|"), 256).alias("texts"))


FRAGMENTS = "SELECT *, id // 9 % 2 + 2 AS n_cols, id % 4 + 1 AS n_rows, lag(l) OVER w AS p_l, lag(r) OVER w AS p_r, lag(b) OVER w AS p_b, lag(id // 9 % 2 + 2) OVER w AS p_cols FROM v_boxes WINDOW w AS (PARTITION BY page, l // 200 ORDER BY t, id)"
JOINS = "t - p_b BETWEEN -2 AND 24 AND n_cols = p_cols AND (least(r, p_r) - greatest(l, p_l)) * 10 >= 8 * least(r - l, p_r - p_l)"


@query(sql(f"SELECT id, page, chain, sum(n_rows) OVER (PARTITION BY page, c, chain ORDER BY t, id ROWS UNBOUNDED PRECEDING)::BIGINT - n_rows AS row_offset FROM (SELECT *, l // 200 AS c, sum(CASE WHEN {JOINS} THEN 0 ELSE 1 END) OVER (PARTITION BY page, l // 200 ORDER BY t, id ROWS UNBOUNDED PRECEDING)::BIGINT AS chain FROM ({FRAGMENTS}))", "v_boxes"))
def table_fragments(spark, sf_dir):
    """Fragments of a table in a chain, and where each one's rows begin: as many columns, a gap of -2 to 24, widths that overlap by 0.8."""
    column = F.floor(F.col("l") / 200)
    b = V.boxes(spark, sf_dir).select("id", "page", "l", "t", "r", "b", column.alias("c"), (F.floor(F.col("id") / 9) % 2 + 2).alias("n_cols"), (F.col("id") % 4 + 1).alias("n_rows"))
    w = Window.partitionBy("page", "c").orderBy("t", "id")
    for name in ("l", "r", "b", "n_cols"):
        b = b.withColumn(f"p_{name}", F.lag(name).over(w))
    goes_on = F.expr(JOINS.replace("p_cols", "p_n_cols"))
    b = b.withColumn("chain", F.sum(F.when(goes_on, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = F.sum("n_rows").over(Window.partitionBy("page", "c", "chain").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_rows")
    return b.select("id", "page", "chain", rows.alias("row_offset"))


@query(sql("""SELECT doc_id, node, row_number() OVER (PARTITION BY doc_id ORDER BY ord, sub_ord) - 1 AS place FROM (SELECT doc_id, ord, CASE WHEN cut THEN span_ord ELSE 0 END AS sub_ord, CASE WHEN cut THEN span_id ELSE unit_id END AS node FROM (
SELECT *, n > 1 AND heads = n AS cut FROM (SELECT *, count(*) OVER (PARTITION BY unit_id) AS n FROM v_spans) JOIN (SELECT unit_id, count(DISTINCT split_part(source, ' ', 1)) AS heads FROM v_spans GROUP BY 1) USING (unit_id)) WHERE cut OR span_ord = 1)""", *SPANS))  # fmt: skip
def nodes_replaced(spark, sf_dir):
    """The children of a document with each unit that is to be split replaced, in its place, by its pieces."""
    s = V.spans(spark, sf_dir).select("doc_id", "ord", "unit_id", "span_ord", "span_id", F.split("source", " ")[0].alias("head"))
    g = s.groupBy("doc_id", "ord", "unit_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("head").alias("heads"), F.sort_array(F.collect_list(F.struct("span_ord", F.col("span_id").alias("node")))).alias("pieces"))
    whole = F.array(F.struct(F.lit(0).alias("span_ord"), F.col("unit_id").alias("node")))
    nodes = g.select("doc_id", "ord", F.explode(F.when((F.col("n") > 1) & (F.col("heads") == F.col("n")), F.col("pieces")).otherwise(whole)).alias("x"))
    return nodes.select("doc_id", "x.node", (F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "x.span_ord")) - 1).alias("place"))


#: How often a batch is halved at most.
DEPTH = 10


@query(sql(f"""SELECT doc_id, lo, hi - lo + 1 AS units, depth, fails > 0 AS failed FROM steps WHERE fails = 0 OR lo = hi OR depth = {DEPTH}""", *UNITS).replace("WITH ", "WITH RECURSIVE ", 1).replace("\nSELECT doc_id, lo", f""",
n AS (SELECT doc_id, list((doc_id * 31 + ord) % 23 = 0 ORDER BY ord) AS f FROM v_units GROUP BY 1),
steps AS (SELECT doc_id, f, 1::BIGINT AS lo, len(f) AS hi, 0 AS depth, len(list_filter(f, lambda x: x)) AS fails FROM n
UNION ALL SELECT doc_id, f, x.lo, x.hi, depth, len(list_filter(f[x.lo:x.hi], lambda x: x)) FROM (SELECT doc_id, f, depth + 1 AS depth, unnest([{{'lo': lo, 'hi': lo + (hi - lo + 2) // 2 - 1}}, {{'lo': lo + (hi - lo + 2) // 2, 'hi': hi}}]) AS x FROM steps WHERE fails > 0 AND lo < hi AND depth < {DEPTH}))
SELECT doc_id, lo""", 1))  # fmt: skip
def halvings(spark, sf_dir):
    """Batches that fail are halved until what fails stands alone (or ten times): the batches that are left, and which of these still fail.

    One shuffle, by document: each round is a window within its batches."""
    u = V.units(spark, sf_dir).select("doc_id", "ord", ((F.col("doc_id") * 31 + F.col("ord")) % 23 == 0).cast("int").alias("f")).repartition("doc_id")
    w = Window.partitionBy("doc_id")
    u = u.withColumn("k", F.row_number().over(w.orderBy("ord")).cast("long")).withColumn("lo", F.lit(1).cast("long")).withColumn("hi", F.count(F.lit(1)).over(w)).withColumn("depth", F.lit(0))
    for _ in range(DEPTH):
        cut = (F.sum("f").over(Window.partitionBy("doc_id", "lo")) > 0) & (F.col("lo") < F.col("hi"))
        mid = F.col("lo") + F.floor((F.col("hi") - F.col("lo") + 2) / 2) - 1
        u = u.withColumns({"cut": cut, "mid": mid}).withColumns({
            "lo": F.when(F.col("cut") & (F.col("k") > F.col("mid")), F.col("mid") + 1).otherwise(F.col("lo")),
            "hi": F.when(F.col("cut") & (F.col("k") <= F.col("mid")), F.col("mid")).otherwise(F.col("hi")),
            "depth": F.col("depth") + F.col("cut").cast("int"),
        }).drop("cut", "mid")
    return u.groupBy("doc_id", "lo").agg(F.count(F.lit(1)).alias("units"), F.max("depth").alias("depth"), (F.sum("f") > 0).alias("failed"))
