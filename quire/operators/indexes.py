"""Items of a table of contents, told from page to page: titles, lists of entries, tables of page numbers.

One pass: a table's cells are summed up by column, then a window over a page knows whether a title stands there and from
which item on a list of entries makes it an index page. Pages are small; items without a page share no group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import rules as R
from quire.plans.registry import query
from quire.sources import views as V
from quire.sources.views import sql

HEADINGS, ENTRIES, INDEX = ("title", "section_header", "heading", "header"), ("text", "list_item"), "document_index"
PAGE_NUMBER = r"(?i)^(?:[0-9]+|[ivxlcdm]+)$"
#: The ends of lines.
LINE = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def holds_entry(text: Column) -> Column:
    """Whether a line of text is an entry: words, a leader, a page."""
    return F.coalesce(F.exists(F.split(text, LINE), lambda x: stripped(x).rlike(R.INDEX_ENTRY)), F.lit(False))


def index_items(items: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc, item, why) of the index items. items: doc, item, ord, page, label, text; cells: item, col, header, text.

    why: `title` (a heading that names an index), `leader` (an index item with a line that is an entry, in its text or cells),
    `numbers` (an index item of several columns, its last one all page numbers, on a page with a title or after a leader),
    `entry` (a text that is an entry, on a page with a title or a leader).

    Cases: an item without a page is a title or leader at most; a null text is empty; a last column without filled body cells has no
    numbers; repeated items each get a row; items of other labels and cells of no item are passed over; further columns are not carried."""
    text = stripped(F.coalesce("text", F.lit("")))
    columns = cells.groupBy("item", "col").agg(
        F.bool_or(holds_entry(F.col("text"))).alias("leader"),
        F.bool_and(F.when(~F.coalesce("header", F.lit(False)) & (text != ""), text.rlike(PAGE_NUMBER))).alias("numbers"),
    )
    tables = columns.groupBy("item").agg(F.bool_or("leader").alias("cell_leader"), F.max(F.struct("col", "numbers")).alias("last"))
    index = F.col("label") == INDEX
    marked = items.where(F.col("label").isin(*HEADINGS, *ENTRIES, INDEX)).join(tables, "item", "left").select(
        "doc", "item", "ord", "page",
        (F.col("label").isin(*HEADINGS) & text.rlike(R.INDEX_TITLE)).alias("title"),
        (F.col("label").isin(*ENTRIES) & text.rlike(R.INDEX_ENTRY)).alias("entry"),
        (index & (holds_entry(F.col("text")) | F.coalesce("cell_leader", F.lit(False)))).alias("leader"),
        (index & F.coalesce((F.col("last.col") > 0) & F.col("last.numbers"), F.lit(False))).alias("numbers"),
    )
    page = Window.partitionBy("doc", "page", F.when(F.col("page").isNull(), F.col("item")))
    seen = marked.withColumn("titled", F.bool_or("title").over(page)).withColumn("from", F.min(F.when(F.col("leader"), F.col("ord"))).over(page))
    placed = F.col("page").isNotNull()
    why = (
        F.when(F.col("title"), "title").when(F.col("leader"), "leader")
        .when(placed & F.col("numbers") & (F.col("titled") | (F.col("from") < F.col("ord"))), "numbers")
        .when(placed & F.col("entry") & (F.col("titled") | F.col("from").isNotNull()), "entry")
    )
    return seen.select("doc", "item", why.alias("why")).where("why IS NOT NULL")


_ITEMS = """SELECT o_custkey AS doc, 't' || o_orderkey AS item, o_orderkey AS ord, year(o_orderdate)::INT AS page, CASE left(o_orderpriority, 1) WHEN '1' THEN 'section_header' WHEN '2' THEN 'list_item' ELSE 'text' END AS label,
CASE WHEN left(o_orderpriority, 1) = '1' AND o_orderstatus = 'P' THEN 'Contents' WHEN left(o_orderpriority, 1) = '2' THEN 'order ' || o_orderkey || ' .... ' || o_custkey WHEN o_orderstatus = 'F' THEN 'part of ' || o_orderkey || '… iv' ELSE o_orderpriority END AS text FROM orders
UNION ALL SELECT o_custkey, 'b' || o_orderkey, o_orderkey + 1000000000000, year(o_orderdate)::INT, CASE WHEN o_orderstatus = 'O' THEN 'table' ELSE 'document_index' END, '' FROM orders"""
_CELLS = """SELECT 'b' || l_orderkey AS item, 0 AS col, l_linenumber = 1 AS header, 'part ' || l_partkey || CASE WHEN l_discount = 0 THEN ' .. ' || l_suppkey ELSE '' END AS text FROM lineitem
UNION ALL SELECT 'b' || l_orderkey, 1, l_linenumber = 1, CASE WHEN l_tax = 0 THEN l_returnflag ELSE l_quantity::BIGINT::VARCHAR END FROM lineitem WHERE l_suppkey % 8 <> 0"""


def order_items(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Customers as documents, years as pages: each order a text and, after all texts, a table of its lines."""
    orders, lines = V.table(spark, sf_dir, "orders"), V.table(spark, sf_dir, "lineitem")
    first, key, status = F.left("o_orderpriority", F.lit(1)), F.col("o_orderkey"), F.col("o_orderstatus")
    text = F.when((first == "1") & (status == "P"), "Contents").when(first == "2", F.concat(F.lit("order "), key, F.lit(" .... "), "o_custkey")).when(status == "F", F.concat(F.lit("part of "), key, F.lit("… iv"))).otherwise(F.col("o_orderpriority"))
    shared = [F.col("o_custkey").alias("doc"), F.year("o_orderdate").alias("page")]
    texts = orders.select(*shared, F.concat(F.lit("t"), key).alias("item"), key.alias("ord"), F.when(first == "1", "section_header").when(first == "2", "list_item").otherwise("text").alias("label"), text.alias("text"))
    tables = orders.select(*shared, F.concat(F.lit("b"), key).alias("item"), (key + 1_000_000_000_000).alias("ord"), F.when(status == "O", "table").otherwise(INDEX).alias("label"), F.lit("").alias("text"))
    item, header = F.concat(F.lit("b"), "l_orderkey").alias("item"), (F.col("l_linenumber") == 1).alias("header")
    names = F.concat(F.lit("part "), "l_partkey", F.when(F.col("l_discount") == 0, F.concat(F.lit(" .. "), "l_suppkey")).otherwise(""))
    pages = F.when(F.col("l_tax") == 0, F.col("l_returnflag")).otherwise(F.col("l_quantity").cast("long").cast("string"))
    cells = lines.select(item, F.lit(0).alias("col"), header, names.alias("text")).unionByName(lines.where("l_suppkey % 8 <> 0").select(item, F.lit(1).alias("col"), header, pages.alias("text")))
    return texts.unionByName(tables), cells


@query(f"""WITH items AS ({_ITEMS}), cells AS ({_CELLS}), cols AS (SELECT item, col, bool_or(regexp_matches(trim(text), '{R.INDEX_ENTRY}')) AS leader, bool_and(regexp_matches(text, '{PAGE_NUMBER}')) FILTER (WHERE NOT header AND text <> '') AS numbers FROM cells GROUP BY 1, 2),
tabs AS (SELECT item, bool_or(leader) AS leader, max(col) > 0 AND coalesce(arg_max_null(numbers, col), false) AS numbers FROM cols GROUP BY 1),
marked AS (SELECT doc, item, ord, page, label = 'section_header' AND regexp_matches(text, '{R.INDEX_TITLE}') AS title, label IN ('text', 'list_item') AND regexp_matches(text, '{R.INDEX_ENTRY}') AS entry, label = 'document_index' AND coalesce(t.leader, false) AS leader, label = 'document_index' AND coalesce(t.numbers, false) AS numbers FROM items LEFT JOIN tabs t USING (item)),
pages AS (SELECT doc, page, bool_or(title) AS titled, min(ord) FILTER (WHERE leader) AS start FROM marked WHERE title OR leader GROUP BY 1, 2)
SELECT doc, item, CASE WHEN title THEN 'title' WHEN leader THEN 'leader' WHEN numbers THEN 'numbers' ELSE 'entry' END AS why FROM marked LEFT JOIN pages USING (doc, page) WHERE title OR leader OR (numbers AND (titled OR start < ord)) OR (entry AND (titled OR start IS NOT NULL))""")  # fmt: skip
def index_page_items(spark, sf_dir):
    """Items of tables of contents: titles, index items confirmed by leaders or page numbers, entries on their pages."""
    return index_items(*order_items(spark, sf_dir))
