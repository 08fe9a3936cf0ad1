"""Window computations, sorts and limits over ordered units, cells, turns and calls."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions.folds import batch_numbers
from quire.functions.text import by_row
from quire.plans.registry import query
from quire.sources import views as V
from quire.sources.views import CELLS, SPANS, UNITS, sql


def up_to(w: Window, last: int = 0) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, last)


@query(sql("SELECT unit_id, round((page - 1) / greatest(1, max(page) OVER (PARTITION BY doc_id) - 1)::DOUBLE, 6) AS position FROM v_units", *UNITS))
def unit_position(spark, sf_dir):
    last = F.max("page").over(Window.partitionBy("doc_id"))
    return V.units(spark, sf_dir).select("unit_id", F.round((F.col("page") - 1) / F.greatest(F.lit(1), last - 1), 6).alias("position"))


@query(sql("SELECT tab, row, col, first_value(CASE WHEN regexp_matches(text, '[A-Za-z0-9]') THEN text END IGNORE NULLS) OVER (PARTITION BY tab, row ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS label FROM v_cells", *CELLS))
def cell_row_label(spark, sf_dir):
    """The first text with a letter or digit to the left."""
    w = up_to(Window.partitionBy("tab", "row").orderBy("col"), -1)
    return V.cells(spark, sf_dir).select("tab", "row", "col", F.first(F.when(F.col("text").rlike("[A-Za-z0-9]"), F.col("text")), True).over(w).alias("label"))


@query(sql("SELECT tab, row, col, CASE WHEN row > 0 THEN max(CASE WHEN header AND row = 0 THEN text END) OVER (PARTITION BY tab, col) END AS label FROM v_cells", *CELLS))
def cell_column_label(spark, sf_dir):
    """The header of a cell's column in the table's first row."""
    c = V.cells(spark, sf_dir)
    w = Window.partitionBy("tab", "col").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return c.select("tab", "row", "col", F.last(F.when(F.col("header") & (F.col("row") == 0), F.col("text")), True).over(w).alias("label"))


@query(sql("SELECT tab, row, concat_ws(' | ', 'previous: ' || p, 'next: ' || n) AS labels FROM (SELECT tab, row, CASE WHEN NOT lag(header) OVER w THEN lag(text) OVER w END AS p, lead(text) OVER w AS n FROM v_cells WHERE col = 0 WINDOW w AS (PARTITION BY tab ORDER BY row))", *CELLS))
def adjacent_row_labels(spark, sf_dir):
    """Labels of the rows before and after, header rows left out."""
    w = Window.partitionBy("tab").orderBy("row")
    prev = F.when(~F.lag("header").over(w), F.concat(F.lit("previous: "), F.lag("text").over(w)))
    return V.cells(spark, sf_dir).where("col = 0").select("tab", "row", F.concat_ws(" | ", prev, F.concat(F.lit("next: "), F.lead("text").over(w))).alias("labels"))


@query(sql("SELECT a.unit_id, string_agg(b.ord::VARCHAR, ',' ORDER BY b.ord) AS neighbors FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM v_units) a JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM v_units) b ON a.doc_id = b.doc_id AND abs(a.k - b.k) BETWEEN 1 AND 3 AND NOT starts_with(b.text, '|') GROUP BY 1", *UNITS))
def neighbors3(spark, sf_dir):
    """Three units before and after, of these the ones of running text (no table lines)."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    text = F.when(~F.col("text").startswith("|"), F.col("ord"))  # collect_list passes nulls over
    near = F.concat(F.collect_list(text).over(w.rowsBetween(-3, -1)), F.collect_list(text).over(w.rowsBetween(1, 3)))
    u = V.units(spark, sf_dir).select("unit_id", near.alias("n")).where(F.size("n") > 0)
    return u.select("unit_id", F.array_join(F.transform("n", lambda x: x.cast("string")), ",").alias("neighbors"))


#: Units on each side of a target; with FEW list items or more as many as there are, up to MOST.
BESIDE, FEW, MOST = 3, 4, 30


@query(sql(f"SELECT a.unit_id, string_agg(b.ord::VARCHAR, ',' ORDER BY b.ord < a.ord, abs(b.ord - a.ord)) AS neighbors FROM (SELECT *, count(*) FILTER (WHERE kind = 'list_item') OVER (PARTITION BY doc_id) AS items FROM v_units) a JOIN v_units b ON a.doc_id = b.doc_id AND abs(a.ord - b.ord) BETWEEN 1 AND CASE WHEN items >= {FEW} THEN least(greatest({BESIDE}, items), {MOST}) ELSE {BESIDE} END WHERE a.kind = 'list_item' GROUP BY 1", *UNITS))
def target_neighbors(spark, sf_dir):
    """Units that follow a target, nearest first, then those before it; farther ones too in documents with several list items."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    items = F.count_if(F.col("kind") == "list_item").over(Window.partitionBy("doc_id"))
    far = F.when(F.col("items") >= FEW, F.least(F.greatest(F.lit(BESIDE), F.col("items")), F.lit(MOST))).otherwise(BESIDE)
    after, before = F.collect_list("ord").over(w.rangeBetween(1, MOST)), F.reverse(F.collect_list("ord").over(w.rangeBetween(-MOST, -1)))
    u = V.units(spark, sf_dir).select("unit_id", "kind", "ord", items.alias("items"), F.concat(after, before).alias("n")).where("kind = 'list_item'")
    near = u.select("unit_id", F.filter("n", lambda x: F.abs(x - F.col("ord")) <= far).alias("n")).where("size(n) > 0")
    return near.select("unit_id", F.array_join(F.transform("n", lambda x: x.cast("string")), ",").alias("neighbors"))


@query(sql("SELECT p.doc_id, p.page, string_agg(h.ord::VARCHAR, ',' ORDER BY h.ord) AS headings FROM (SELECT DISTINCT doc_id, page FROM v_units WHERE page > 1) p JOIN (SELECT doc_id, page, ord FROM v_units WHERE ord % 4 = 1) h ON h.doc_id = p.doc_id AND h.page < p.page AND (SELECT count(*) FROM v_units x WHERE x.doc_id = p.doc_id AND x.ord % 4 = 1 AND x.page < p.page AND x.ord > h.ord) < 8 GROUP BY 1, 2", *UNITS))
def heading_history(spark, sf_dir):
    """The last eight headings of the pages before."""
    pages = V.units(spark, sf_dir).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.when(F.col("ord") % 4 == 1, F.col("ord")))).alias("own"))
    before = F.flatten(F.collect_list("own").over(up_to(Window.partitionBy("doc_id").orderBy("page"), -1)))
    last = F.slice("b", F.greatest(F.lit(1), F.size("b") - 7), 8)
    return pages.withColumn("b", before).where("page > 1 AND size(b) > 0").select("doc_id", "page", F.array_join(F.transform(last, lambda x: x.cast("string")), ",").alias("headings"))


@query(sql("SELECT unit_id, CASE WHEN ord % 5 = 0 THEN least(6, 1 + ord % 4) WHEN seen AND page > 1 THEN 2 ELSE 1 END AS level FROM (SELECT *, count(*) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS seen FROM v_units WHERE kind <> 'paragraph')", *UNITS))
def heading_levels(spark, sf_dir):
    """Levels of headings: by number, else by whether one came before on an earlier page."""
    u = V.units(spark, sf_dir).where("kind <> 'paragraph'")
    seen = F.count(F.lit(1)).over(up_to(Window.partitionBy("doc_id").orderBy("ord"), -1)) > 0
    return u.select("unit_id", F.when(F.col("ord") % 5 == 0, F.least(F.lit(6), 1 + F.col("ord") % 4)).when(seen & (F.col("page") > 1), 2).otherwise(1).alias("level"))


@query(sql("SELECT unit_id, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) - 1 AS new_order FROM v_v2 JOIN (SELECT unit_id, page FROM v_units) USING (unit_id)", *UNITS, "v_v2"))
def reindex_blocks(spark, sf_dir):
    """Blocks numbered anew after some are gone."""
    pages = V.units(spark, sf_dir).select("unit_id", "page")
    return V.version2(spark, sf_dir).join(pages, "unit_id").select("unit_id", (F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("ord")) - 1).alias("new_order"))


@query(sql("SELECT span_id, sum(length(source)) OVER (PARTITION BY unit_id ORDER BY span_ord ROWS UNBOUNDED PRECEDING)::BIGINT - length(source) AS start FROM v_spans", *SPANS))
def sentence_offsets(spark, sf_dir):
    w = up_to(Window.partitionBy("unit_id").orderBy("span_ord"))
    return V.spans(spark, sf_dir).select("span_id", (F.sum(F.length("source")).over(w) - F.length("source")).alias("start"))


@query(sql("SELECT child, '#/' || label || '/' || (row_number() OVER (PARTITION BY label ORDER BY child) - 1) AS ref FROM v_edges WHERE child % 7 <> 0", "v_edges"))
def ref_renumber(spark, sf_dir):
    """Dense numbers of the nodes that are left, in each collection.

    Two steps: numbers within ranges of ids, then the ranges' offsets, so no collection is one task."""
    e = V.edges(spark, sf_dir).where("child % 7 <> 0").select("child", "label", F.floor(F.col("child") / 100_000).alias("range"))
    sizes = e.groupBy("label", "range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("label", "range", (F.sum("n").over(Window.partitionBy("label").orderBy("range")) - F.col("n")).alias("before"))
    local = F.row_number().over(Window.partitionBy("label", "range").orderBy("child")) - 1
    return e.withColumn("k", local).join(before, ["label", "range"]).select("child", F.concat(F.lit("#/"), F.col("label"), F.lit("/"), F.col("before") + F.col("k")).alias("ref"))


@query(sql("SELECT span_id, printf('span-%04d', row_number() OVER (PARTITION BY unit_id ORDER BY span_ord)) AS name FROM v_spans", *SPANS))
def sequence_ids(spark, sf_dir):
    return V.spans(spark, sf_dir).select("span_id", F.format_string("span-%04d", F.row_number().over(Window.partitionBy("unit_id").orderBy("span_ord"))).alias("name"))


@query(sql("SELECT task, max(n) AS longest FROM (SELECT task, g, count(*) FILTER (WHERE status <> 'succeeded') AS n FROM (SELECT *, sum((status = 'succeeded')::INT) OVER (PARTITION BY task ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM v_calls) GROUP BY 1, 2) GROUP BY 1", "v_calls"))
def idle_runs(spark, sf_dir):
    """The longest run of calls without progress."""
    g = F.sum((F.col("status") == "succeeded").cast("int")).over(up_to(Window.partitionBy("task").orderBy("ts", "event_id")))
    runs = V.calls(spark, sf_dir).withColumn("g", g).groupBy("task", "g").agg(F.count_if(F.col("status") != "succeeded").alias("n"))
    return runs.groupBy("task").agg(F.max("n").alias("longest"))


@query(sql("SELECT doc_id, text, ord FROM (SELECT doc_id, text, ord, row_number() OVER (PARTITION BY doc_id, text ORDER BY ord) AS k FROM v_units) WHERE k = 1", *UNITS))
def first_seen(spark, sf_dir):
    """Of equal lines in a document, the first."""
    return V.units(spark, sf_dir).groupBy("doc_id", "text").agg(F.min("ord").alias("ord"))


@query(sql("SELECT span_id, coalesce(starts_with(source, p), false) AS copies_previous, coalesce(ends_with(source, n), false) AS copies_next FROM (SELECT span_id, source, substr(lag(source) OVER w, 1, 4) AS p, right(lead(source) OVER w, 3) AS n FROM v_spans WINDOW w AS (PARTITION BY unit_id ORDER BY span_ord))", *SPANS))
def edit_adjacent_copy(spark, sf_dir):
    """Whether a span begins like the one before it, or ends like the next."""
    w = Window.partitionBy("unit_id").orderBy("span_ord")
    s = V.spans(spark, sf_dir).select("span_id", "source", F.substring(F.lag("source").over(w), 1, 4).alias("p"), F.right(F.lead("source").over(w), F.lit(3)).alias("n"))
    return s.select("span_id", F.coalesce(F.col("source").startswith(F.col("p")), F.lit(False)).alias("copies_previous"), F.coalesce(F.col("source").endswith(F.col("n")), F.lit(False)).alias("copies_next"))


@query(sql("SELECT doc_id, unit_id, k FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, ord) AS k FROM v_units) WHERE k <= 8", *UNITS))
def candidate_rank(spark, sf_dir):
    """The best eight by score; ties keep the document's order."""
    w = Window.partitionBy("doc_id").orderBy(F.length("text").desc(), "ord")
    return V.units(spark, sf_dir).withColumn("k", F.row_number().over(w)).where("k <= 8").select("doc_id", "unit_id", "k")


@query(sql("SELECT doc_id, unit_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY length(text) DESC, ord) AS k FROM v_units) WHERE k <= CASE kind WHEN 'paragraph' THEN 8 WHEN 'list_item' THEN 2 ELSE 1 END", *UNITS))
def rerank_pool(spark, sf_dir):
    """Bounded pools of each kind."""
    w = Window.partitionBy("doc_id", "kind").orderBy(F.length("text").desc(), "ord")
    cap = F.when(F.col("kind") == "paragraph", 8).when(F.col("kind") == "list_item", 2).otherwise(1)
    return V.units(spark, sf_dir).withColumn("k", F.row_number().over(w)).where((F.col("k") <= 8) & (F.col("k") <= cap)).select("doc_id", "unit_id")


@query(sql("SELECT task, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS last_ids FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY event_id DESC) AS k FROM v_calls WHERE status = 'succeeded') WHERE k <= 8 GROUP BY 1", "v_calls"))
def agent_state(spark, sf_dir):
    """The last eight reviewed ids of a task, in order."""
    w = Window.partitionBy("task").orderBy(F.desc("event_id"))
    last = V.calls(spark, sf_dir).where("status = 'succeeded'").withColumn("k", F.row_number().over(w)).where("k <= 8")
    return last.groupBy("task").agg(F.array_join(F.transform(F.sort_array(F.collect_list("event_id")), lambda x: x.cast("string")), ",").alias("last_ids"))


@query(sql("SELECT doc_id, unit_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, kind) AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY ord) AS k FROM v_units)", *UNITS))
def round_robin(spark, sf_dir):
    """Kinds interleaved: the first of each, then the second of each."""
    u = V.units(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("ord")))
    return u.select("doc_id", "unit_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("k", "kind")).alias("place"))


@query(sql("SELECT doc_id, max(k) AS kept, max(used)::BIGINT AS bytes FROM (SELECT *, row_number() OVER w AS k, sum(strlen(text)) OVER w AS used FROM v_units WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING)) WHERE used <= 2000 GROUP BY 1", *UNITS))
def budget_prefix(spark, sf_dir):
    """The longest run of units from the first on that fits a budget of bytes."""
    w = up_to(Window.partitionBy("doc_id").orderBy("ord"))
    u = V.units(spark, sf_dir).select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")).alias("k"), F.sum(F.octet_length("text")).over(w).alias("used"))
    return u.where("used <= 2000").groupBy("doc_id").agg(F.max("k").alias("kept"), F.max("used").alias("bytes"))


@query()
def observe_page(spark, sf_dir):
    """Pages of at most 32 units and 4,000 bytes; where the next one begins. A unit over the budget is a page alone."""
    u = V.units(spark, sf_dir).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", F.octet_length("text").alias("n")))).alias("u"))
    numbers = by_row(lambda sizes: batch_numbers(sizes, 4000, 32), "array<int>")
    pages = u.select("doc_id", F.explode(F.zip_with("u", numbers(F.transform("u", lambda x: x["n"])), lambda x, page: F.struct(page.alias("page"), x["ord"].alias("ord")))).alias("p"))
    return pages.groupBy("doc_id", F.col("p.page").alias("page")).agg(F.min("p.ord").alias("first"), F.count(F.lit(1)).alias("units"))
