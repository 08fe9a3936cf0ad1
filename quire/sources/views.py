"""Canonical views: the given tables in the shape of the document model, each with its SQL.

Every view is a function of (spark, sf_dir); SQL holds the same rows as a common table expression,
and sql(body, *names) puts those that a query needs before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(body: str, *names: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names) + "\n" + body


SQL["v_lines"] = r"""SELECT doc_id, lang, source, generate_subscripts(l, 1) AS ord, unnest(l) AS text
FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents)"""
SQL["v_units"] = r"""SELECT doc_id, ord, doc_id || '/' || ord AS unit_id, lang, source, CASE WHEN ord = 1 THEN 'heading' WHEN ord % 3 = 0 THEN 'list_item' ELSE 'paragraph' END AS kind,
ord // 10 + 1 AS page, text FROM v_lines WHERE trim(text) <> ''"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each non-blank line of a document: a unit of text in reading order."""
    lines = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    ord_ = (F.col("pos") + 1).alias("ord")
    lines = lines.select("doc_id", "lang", "source", ord_, "text").where(F.trim("text") != "")
    kind = F.when(F.col("ord") == 1, "heading").when(F.col("ord") % 3 == 0, "list_item").otherwise("paragraph")
    return lines.select("doc_id", "ord", F.concat_ws("/", "doc_id", "ord").alias("unit_id"), "lang", "source", kind.alias("kind"), (F.floor(F.col("ord") / 10) + 1).cast("int").alias("page"), "text")


UNITS = ("v_lines", "v_units")

SQL["v_spans"] = r"""SELECT doc_id, ord, unit_id, span_ord, unit_id || '/s' || span_ord AS span_id, CASE WHEN span_ord % 5 = 4 THEN 'code' WHEN span_ord % 7 = 6 THEN 'line_break' WHEN span_ord % 11 = 5 THEN 'link' ELSE 'text' END AS kind, source,
CASE WHEN (ord + span_ord) % 5 = 0 THEN '' WHEN (ord + span_ord) % 3 = 0 THEN 'T: ' || source END AS translated, CASE WHEN (ord + span_ord) % 7 = 0 THEN lower(source) END AS revised,
span_ord % 2 = 0 AS bold, span_ord % 3 = 0 AS italic, span_ord % 4 = 0 AS strike
FROM (SELECT doc_id, ord, unit_id, generate_subscripts(l, 1) AS span_ord, unnest(l) AS source FROM (SELECT *, string_split(text, '. ') AS l FROM v_units))"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of a unit as spans, some with a translation or a revision, and with formatting flags."""
    s = units(spark, sf_dir).select("doc_id", "ord", "unit_id", F.posexplode(F.split("text", r"\. ")).alias("p", "source")).withColumn("span_ord", F.col("p") + 1)
    n, m = F.col("span_ord"), F.col("ord") + F.col("span_ord")
    kind = F.when(n % 5 == 4, "code").when(n % 7 == 6, "line_break").when(n % 11 == 5, "link").otherwise("text")
    return s.select(
        "doc_id", "ord", "unit_id", "span_ord", F.concat(F.col("unit_id"), F.lit("/s"), n).alias("span_id"), kind.alias("kind"), "source",
        F.when(m % 5 == 0, "").when(m % 3 == 0, F.concat(F.lit("T: "), F.col("source"))).alias("translated"), F.when(m % 7 == 0, F.lower("source")).alias("revised"),
        (n % 2 == 0).alias("bold"), (n % 3 == 0).alias("italic"), (n % 4 == 0).alias("strike"),
    )


SPANS = (*UNITS, "v_spans")

SQL["v_v2"] = r"""SELECT doc_id, ord, unit_id, kind, CASE WHEN (doc_id * 31 + ord) % 11 = 0 THEN text || ' x' ELSE text END AS text FROM v_units WHERE (doc_id * 31 + ord) % 7 <> 0"""
SQL["v_tr"] = r"""SELECT doc_id, ord, unit_id, kind, 'T: ' || text AS text FROM v_units WHERE (doc_id * 31 + ord) % 13 <> 0"""


def version2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later version of the units: some are gone, some changed."""
    k = F.col("doc_id") * 31 + F.col("ord")
    return units(spark, sf_dir).where(k % 7 != 0).select("doc_id", "ord", "unit_id", "kind", F.when(k % 11 == 0, F.concat("text", F.lit(" x"))).otherwise(F.col("text")).alias("text"))


def translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A translation of most units."""
    return units(spark, sf_dir).where((F.col("doc_id") * 31 + F.col("ord")) % 13 != 0).select("doc_id", "ord", "unit_id", "kind", F.concat(F.lit("T: "), F.col("text")).alias("text"))


#: What stands around a unit's text, by the remainder of k by 14: one case for each rule on texts. # is k by 20, @ by 7, ~ by 28.
MARKS = (
    "\x07 {}.....", " #.@  {}", "Chapter # {}", "(@) {} (#) and ( ~ ) next", "Figure #.@: {}", "{} ........ ~", "2024-0@-~", '```json\n{{"id": #, "b": null}}\n```',
    "![c #](img@.png) {} ![d](http://h/~.png)", "XV-@ ~", "../a%20b/#.png?q=@", "日本 語 の text # {}", "{}\t#", "目次",
)


def _mark_sql(i: int) -> str:
    before, _, after = MARKS[i].partition("{}")
    quoted = []
    for part in ((before, after) if "{}" in MARKS[i] else (before,)):
        part = part.replace("{{", "{").replace("}}", "}").replace("'", "''")
        for c in "\x07\n\t":
            part = part.replace(c, f"' || chr({ord(c)}) || '")
        for c, n in (("#", 20), ("@", 7), ("~", 28)):
            part = part.replace(c, f"' || (k % {n}) || '")
        quoted.append(f"'{part}'")
    return " || text || ".join(quoted)


SQL["v_marked"] = "SELECT unit_id, doc_id, ord, k, CASE k % 14 " + " ".join(f"WHEN {i} THEN {_mark_sql(i)}" for i in range(len(MARKS))) + " END AS raw FROM (SELECT *, doc_id * 31 + ord AS k FROM v_units)"


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units with what rules on texts look for: numbers, leaders, captions, dates, fences, images, page references, paths."""
    u = units(spark, sf_dir).select("unit_id", "doc_id", "ord", (F.col("doc_id") * 31 + F.col("ord")).alias("k"), "text")
    raw = F.lit(None).cast("string")
    for i, mark in reversed(list(enumerate(MARKS))):
        before, _, after = mark.partition("{}")
        parts = [F.lit(before.replace("{{", "{").replace("}}", "}"))] + ([F.lit("{}"), F.lit(after)] if "{}" in mark else [])
        one = F.lit("")
        for p in parts:
            for c, n in (("#", 20), ("@", 7), ("~", 28)):
                p = F.replace(p, F.lit(c), (F.col("k") % n).cast("string"))
            one = F.concat(one, p)
        one = F.replace(one, F.lit("{}"), F.col("text")) if "{}" in mark else one
        raw = F.when(F.col("k") % 14 == i, one).otherwise(raw)
    return u.select("unit_id", "doc_id", "ord", "k", raw.alias("raw"))


MARKED = (*UNITS, "v_marked")

SQL["v_rows"] = r"""SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem"""
SQL["v_cells"] = r"""SELECT l_orderkey AS tab, r AS row, l_linenumber AS line, c AS col, false AS header, CASE c WHEN 0 THEN 'part ' || l_partkey WHEN 1 THEN CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE 's' || l_suppkey END WHEN 2 THEN l_quantity::BIGINT::VARCHAR WHEN 3 THEN CASE WHEN l_partkey % 5 = 0 THEN '--' ELSE round(l_extendedprice)::BIGINT::VARCHAR END ELSE l_returnflag END AS text
FROM v_rows, (SELECT unnest(range(5))::INT AS c) UNION ALL
SELECT DISTINCT l_orderkey, 0, 0, c, true, CASE c WHEN 0 THEN 'part' WHEN 1 THEN 'supplier' WHEN 2 THEN '' WHEN 3 THEN 'price' ELSE 'flag' END FROM lineitem, (SELECT unnest(range(5))::INT AS c)"""


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of orders as rows of tables, below a header: a row's texts by column and the first text of the row after it."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    first = lambda part: F.concat(F.lit("part "), part)
    texts = F.array(
        first(F.col("l_partkey")), F.when(F.col("l_suppkey") % 4 == 0, "").otherwise(F.concat(F.lit("s"), F.col("l_suppkey"))),
        F.col("l_quantity").cast("long").cast("string"), F.when(F.col("l_partkey") % 5 == 0, "--").otherwise(F.round("l_extendedprice").cast("long").cast("string")), F.col("l_returnflag"),
    )
    numbered = li.withColumn("row", F.row_number().over(w)).withColumn("after", F.lead("l_partkey").over(w))
    return numbered.select(F.col("l_orderkey").alias("tab"), "row", F.col("l_linenumber").alias("line"), texts.alias("texts"), first(F.col("after")).alias("after"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tables: row 0 is a header, columns 0 to 4; some cells are blank or without a letter or digit."""
    li = table(spark, sf_dir, "lineitem")
    body = rows(spark, sf_dir).select("tab", "row", "line", F.posexplode("texts").alias("col", "text"))
    head = li.select(F.col("l_orderkey").alias("tab")).distinct().select("tab", F.lit(0).alias("row"), F.lit(0).alias("line"), F.posexplode(F.array(*map(F.lit, ("part", "supplier", "", "price", "flag")))).alias("col", "text"))
    return body.withColumn("header", F.lit(False)).unionByName(head.withColumn("header", F.lit(True))).select("tab", "row", "line", "col", "header", "text")


CELLS = ("v_rows", "v_cells")

SQL["v_boxes"] = r"""SELECT p_partkey AS id, p_partkey // 40 AS page, (p_partkey * 37 % 3) * 200 + p_size % 9 AS l, (p_partkey * 53 % 20) * 18 AS t, (p_partkey * 37 % 3) * 200 + p_size % 9 + 40 + p_size * 3 AS r, (p_partkey * 53 % 20) * 18 + 10 + p_size % 13 AS b,
CASE WHEN p_partkey % 9 = 0 THEN 'table' WHEN p_partkey % 9 IN (1, 2) THEN 'image' ELSE 'text' END AS label, p_name AS text FROM part"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as page items with integer boxes in three columns; top is less than bottom."""
    k, s = F.col("p_partkey"), F.col("p_size")
    left = (k * 37 % 3) * 200 + s % 9
    top = (k * 53 % 20) * 18
    label = F.when(k % 9 == 0, "table").when((k % 9).isin(1, 2), "image").otherwise("text")
    return table(spark, sf_dir, "part").select(k.alias("id"), F.floor(k / 40).alias("page"), left.alias("l"), top.alias("t"), (left + 40 + s * 3).alias("r"), (top + 10 + s % 13).alias("b"), label.alias("label"), F.col("p_name").alias("text"))


SQL["v_calls"] = r"""SELECT event_id, 'c' || event_id // 3 AS call_id, user_id AS task, CASE WHEN event_id % 4 = 0 THEN 'match' WHEN event_id % 4 = 1 THEN 'evaluate' ELSE 'recheck' END AS operation,
CASE event_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'partial' WHEN 2 THEN 'processing' ELSE 'succeeded' END AS status, event_id % 17 AS round, 1 + (event_id % 3) AS attempts, round(value)::BIGINT AS tokens, ts, event_type FROM events"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the log of calls: three rows of a call at most, each a later state."""
    e = F.col("event_id")
    op = F.when(e % 4 == 0, "match").when(e % 4 == 1, "evaluate").otherwise("recheck")
    status = F.when(e % 5 == 0, "failed").when(e % 5 == 1, "partial").when(e % 5 == 2, "processing").otherwise("succeeded")
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("c"), F.floor(e / 3)).alias("call_id"), F.col("user_id").alias("task"), op.alias("operation"), status.alias("status"), (e % 17).alias("round"), (1 + e % 3).alias("attempts"), F.round("value").cast("long").alias("tokens"), "ts", "event_type")


SQL["v_files"] = r"""SELECT doc_id, source || '/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.PDF' WHEN doc_id % 3 = 1 THEN '.pdf' ELSE '.txt' END AS path, sha256(text) AS sha, strlen(text) AS size FROM documents"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored files."""
    d = F.col("doc_id")
    ext = F.when(d % 3 == 0, ".PDF").when(d % 3 == 1, ".pdf").otherwise(".txt")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("source"), F.lit("/"), d, ext).alias("path"), F.sha2("text", 256).alias("sha"), F.octet_length("text").alias("size"))


SQL["v_points"] = r"""SELECT doc_id AS id, source AS source_key, 'p' || doc_id % 50 AS logical_path, sha256(text) AS revision, doc_id % 4 AS chunk_index FROM documents"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as points of a vector store."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(d.alias("id"), F.col("source").alias("source_key"), F.concat(F.lit("p"), d % 50).alias("logical_path"), F.sha2("text", 256).alias("revision"), (d % 4).alias("chunk_index"))


SQL["v_edges"] = r"""SELECT o_orderkey AS child, CASE WHEN o_orderkey > 1 THEN o_orderkey // 3 + CASE WHEN o_orderkey < 3 THEN 1 ELSE 0 END END AS parent, CASE WHEN o_orderkey % 5 = 0 THEN 'picture' WHEN o_orderkey % 3 = 0 THEN 'list' ELSE 'text' END AS label FROM orders"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a tree: a node's parent is a third of its number."""
    k = F.col("o_orderkey")
    parent = F.when(k > 1, F.floor(k / 3) + F.when(k < 3, 1).otherwise(0))
    label = F.when(k % 5 == 0, "picture").when(k % 3 == 0, "list").otherwise("text")
    return table(spark, sf_dir, "orders").select(k.alias("child"), parent.alias("parent"), label.alias("label"))
