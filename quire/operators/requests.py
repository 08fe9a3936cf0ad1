"""What goes into a request: targets and blocks in batches within a budget, oversize ones in parts, what is dropped to fit, and edits that come back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.folds import batch_numbers, pieces_of, results_in_order, review_parts
from quire.functions.text import by_row
from quire.plans.registry import query
from quire.sources import views as V
from quire.sources.views import SPANS, UNITS, sql

#: Bytes of a review target, and of a block, besides its texts; items of a batch.
TARGET_BYTES, BLOCK_BYTES, MOST = 60, 40, 64
PART = "array<struct<part:int,start:int,end:int,span:int,spans:int,bytes:long>>"
PIECE = "array<struct<span:int,start:int,end:int,spans:int,bytes:long>>"


def parts_of(targets: DataFrame, budget: int) -> DataFrame:
    """targets (..., source, spans array<string>) exploded by their parts: part, start, end, span, spans, bytes."""
    cut = by_row(lambda source, spans: review_parts(source, spans, budget, TARGET_BYTES), PART)
    keys = [c for c in targets.columns if c not in ("source", "spans")]
    return targets.select(*keys, F.explode(cut("source", "spans")).alias("p")).select(*keys, "p.*")


def blocks_cut(blocks: DataFrame, budget: int) -> DataFrame:
    """blocks (..., spans array<string>) exploded by their pieces: piece 0 of a whole block, 1 and on of an oversize one."""
    cut = by_row(lambda spans: pieces_of(spans, budget, BLOCK_BYTES), PIECE)
    keys = [c for c in blocks.columns if c != "spans"]
    cuts = blocks.select(*keys, cut("spans").alias("cuts"))
    pieces = cuts.select(*keys, F.size("cuts").alias("many"), F.posexplode("cuts").alias("k", "p"))
    return pieces.select(*keys, "p.*", F.when(F.col("many") > 1, F.col("k") + 1).otherwise(0).alias("piece"))


def batched(items: DataFrame, order: list[str], mark: Column, budget: int, most: int = MOST) -> DataFrame:
    """items (doc_id, *order, bytes, ...) with batch: runs in order that fit; items of different marks never share one."""
    w = Window.partitionBy("doc_id").orderBy(*order)
    numbered = items.withColumn("_k", F.row_number().over(w)).withColumn("_mark", mark)
    g = numbered.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("_k", F.col("bytes").alias("n"), F.col("_mark").alias("m")))).alias("x"))
    fold = by_row(lambda sizes, marks: batch_numbers(sizes, budget, most, marks), "array<int>")
    batches = g.select("doc_id", F.posexplode(fold(F.transform("x", lambda x: x["n"]), F.transform("x", lambda x: x["m"]))).alias("_k", "batch")).withColumn("_k", F.col("_k") + 1)
    return numbered.join(batches, ["doc_id", "_k"]).drop("_k", "_mark")


def review_targets_of(spark, sf_dir) -> DataFrame:
    """(doc_id, ord, source, spans): units, and the translated texts of their spans in order."""
    said = F.when(F.col("translated") != "", F.col("translated"))
    s = V.spans(spark, sf_dir).groupBy("doc_id", "ord").agg(F.sort_array(F.collect_list(F.when(said.isNotNull(), F.struct("span_ord", said.alias("t"))))).alias("s"))
    u = V.units(spark, sf_dir).select("doc_id", "ord", F.col("text").alias("source"))
    return u.join(s, ["doc_id", "ord"]).select("doc_id", "ord", "source", F.transform("s", lambda x: x["t"]).alias("spans"))


@query()
def split_target(spark, sf_dir):
    """Review targets in parts of 300 bytes: groups of spans with the sentences of the source that fit, then the rest of the source."""
    return parts_of(review_targets_of(spark, sf_dir), 300)


@query()
def review_batches(spark, sf_dir):
    """Parts of targets in batches of 1,500 bytes; parts with spans and parts without never share one."""
    parts = parts_of(review_targets_of(spark, sf_dir), 1500)
    return batched(parts, ["ord", "part"], (F.col("spans") > 0).cast("int"), 1500).select("doc_id", "batch", "ord", "part", "bytes")


@query()
def structure_batches(spark, sf_dir):
    """Blocks in batches of at most 64 and 400 bytes; each piece of an oversize block, cut at spans or within one, is a batch alone."""
    s = V.spans(spark, sf_dir).groupBy("doc_id", "ord").agg(F.transform(F.sort_array(F.collect_list(F.struct("span_ord", "source"))), lambda x: x["source"]).alias("spans"))
    pieces = blocks_cut(s, 400)
    alone = F.when(F.col("piece") > 0, F.col("ord").cast("long") * 1_000_000 + F.col("piece")).otherwise(0)
    return batched(pieces, ["ord", "piece"], alone, 400).select("doc_id", "batch", "ord", "piece", "span", "start", "end", "bytes")


# ---- what is dropped to fit ----------------------------------------------------------------------


def within_budget(requests: DataFrame, references: DataFrame, budget: int) -> DataFrame:
    """requests (request, targets, glossary, findings: bytes) with references kept, glossary_kept, findings_kept, bytes; all null where the targets alone are too large.

    references: (request, rank, bytes). The lowest ranks go first, then the glossary, then the findings; a list's items are two bytes apart."""
    w = Window.partitionBy("request").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    room = F.lit(budget) - F.col("targets") - F.col("glossary") - F.col("findings")
    summed = references.select("request", "rank", (F.sum(F.col("bytes") + 2).over(w) - 2).alias("upto"))
    fits = summed.join(requests.select("request", room.alias("room")), "request").where("upto <= room").groupBy("request").agg(F.count(F.lit(1)).alias("n"), F.max("upto").alias("upto"))
    r = requests.join(fits, "request", "left").withColumn("room", room)
    g, f = F.col("room") >= 0, F.col("room") + F.col("glossary") >= 0
    possible = F.col("targets") <= budget
    size = F.col("targets") + F.when(f, F.col("findings")).otherwise(0) + F.when(g, F.col("glossary") + F.coalesce("upto", F.lit(0))).otherwise(0)
    return r.select("request", *[F.when(possible, c).alias(n) for c, n in ((F.coalesce("n", F.lit(0)).cast("long"), "references"), (g, "glossary_kept"), (f, "findings_kept"), (size.cast("long"), "bytes"))])


_ASKED = "SELECT doc_id AS request, coalesce(sum(strlen(text)) FILTER (WHERE ord <= 2), 0)::BIGINT AS targets, coalesce(sum(strlen(text)) FILTER (WHERE ord % 7 = 3), 0)::BIGINT AS glossary, coalesce(sum(strlen(text)) FILTER (WHERE ord % 7 = 4), 0)::BIGINT AS findings FROM v_units GROUP BY 1"
#: Bytes of a request.
REQUEST_BYTES = 1200


@query(sql(f"""SELECT request, CASE WHEN targets <= {REQUEST_BYTES} THEN coalesce(n, 0) END AS "references", CASE WHEN targets <= {REQUEST_BYTES} THEN room >= 0 END AS glossary_kept, CASE WHEN targets <= {REQUEST_BYTES} THEN room + glossary >= 0 END AS findings_kept,
CASE WHEN targets <= {REQUEST_BYTES} THEN targets + CASE WHEN room + glossary >= 0 THEN findings ELSE 0 END + CASE WHEN room >= 0 THEN glossary + coalesce(upto, 0) ELSE 0 END END::BIGINT AS bytes
FROM (SELECT *, {REQUEST_BYTES} - targets - glossary - findings AS room FROM ({_ASKED})) LEFT JOIN (SELECT request, count(*) AS n, max(upto) AS upto FROM (SELECT doc_id AS request, sum(strlen(text) + 2) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) - 2 AS upto FROM v_units WHERE ord % 7 IN (5, 6))
JOIN (SELECT request, {REQUEST_BYTES} - targets - glossary - findings AS room FROM ({_ASKED})) USING (request) WHERE upto <= room GROUP BY 1) USING (request)""", *UNITS))  # fmt: skip
def request_budget(spark, sf_dir):
    """Requests of a document's first units, with a glossary, findings and references of the others, as much of them as fits."""
    u = V.units(spark, sf_dir).select("doc_id", "ord", F.octet_length("text").cast("long").alias("n"))
    total = lambda which, name: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)).alias(name)
    asked = u.groupBy(F.col("doc_id").alias("request")).agg(total(F.col("ord") <= 2, "targets"), total(F.col("ord") % 7 == 3, "glossary"), total(F.col("ord") % 7 == 4, "findings"))
    refs = u.where("ord % 7 IN (5, 6)").select(F.col("doc_id").alias("request"), F.col("ord").alias("rank"), F.col("n").alias("bytes"))
    return within_budget(asked, refs, REQUEST_BYTES)


# ---- edits that come back ------------------------------------------------------------------------


def applied(revisions: DataFrame, spans: DataFrame) -> DataFrame:
    """(document, id, result) of revisions (document, id, target, edits array<struct<span, text>>): applied whole, or the first reason why not.

    spans: (target, span), those that a unit owns. Reasons: an unknown target, a span that isn't the target's, two edits of one span, a blank text,
    a span that an applied revision of the document has changed, by order of id."""
    owned = spans.groupBy("target").agg(F.collect_set("span").alias("own"))
    r = revisions.join(owned, "target", "left").withColumn("ids", F.transform("edits", lambda e: e["span"]))
    reason = (
        F.when(F.col("own").isNull(), "unknown_target").when(F.size(F.array_except("ids", "own")) > 0, "unknown_span")
        .when(F.size(F.array_distinct("ids")) < F.size("ids"), "duplicate_edit").when(F.exists("edits", lambda e: F.coalesce(F.trim(e["text"]) == "", F.lit(True))), "empty_text")
    )
    g = r.groupBy("document").agg(F.sort_array(F.collect_list(F.struct("id", reason.alias("reason"), "ids"))).alias("r"))
    fold = by_row(results_in_order, "array<string>")
    results = fold(F.transform("r", lambda x: x["reason"]), F.transform("r", lambda x: x["ids"]))
    return g.select("document", F.explode(F.arrays_zip(F.transform("r", lambda x: x["id"]).alias("id"), results.alias("result"))).alias("x")).select("document", "x.id", "x.result")


def revisions_of(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    target = F.concat_ws("/", e % 200, F.when(e % 19 == 0, 9999).otherwise(1 + e % 3))
    owner = F.when(e % 23 == 0, F.concat_ws("/", e % 200, 2 + e % 3)).otherwise(target)
    edit = lambda unit, n, text: F.struct(F.concat(unit, F.lit("/s"), n).alias("span"), text.alias("text"))
    first = edit(owner, 1 + e % 4, F.when(F.col("tokens") < 5, " ").otherwise(F.col("operation")))
    return V.calls(spark, sf_dir).select((e % 200).alias("document"), F.col("event_id").alias("id"), target.alias("target"), F.array(first, edit(target, 1 + e % 3, F.col("status"))).alias("edits"))


_REVISED = """SELECT event_id % 200 AS document, event_id AS id, (event_id % 200) || '/' || CASE WHEN event_id % 19 = 0 THEN 9999 ELSE 1 + event_id % 3 END AS target,
[CASE WHEN event_id % 23 = 0 THEN (event_id % 200) || '/' || (2 + event_id % 3) ELSE target END || '/s' || (1 + event_id % 4), target || '/s' || (1 + event_id % 3)] AS ids, tokens < 5 AS blank FROM v_calls"""
_REASONED = f"""v_own AS (SELECT unit_id AS target, list(span_id) AS own FROM v_spans GROUP BY 1),
v_rev AS (SELECT document, id, ids, CASE WHEN own IS NULL THEN 'unknown_target' WHEN len(list_filter(ids, lambda x: NOT list_contains(own, x))) > 0 THEN 'unknown_span' WHEN ids[1] = ids[2] THEN 'duplicate_edit' WHEN blank THEN 'empty_text' END AS reason, row_number() OVER (PARTITION BY document ORDER BY id) AS k FROM ({_REVISED}) LEFT JOIN v_own USING (target)),
f AS (SELECT document, id, k, coalesce(reason, 'applied') AS result, CASE WHEN reason IS NULL THEN ids ELSE [] END AS changed FROM v_rev WHERE k = 1 UNION ALL
SELECT r.document, r.id, r.k, coalesce(reason, CASE WHEN list_has_any(changed, ids) THEN 'conflicting_edit' ELSE 'applied' END), CASE WHEN reason IS NULL AND NOT list_has_any(changed, ids) THEN list_concat(changed, ids) ELSE changed END FROM f JOIN v_rev r ON r.document = f.document AND r.k = f.k + 1)"""


def revised_sql(body: str) -> str:
    return sql("", "v_calls", *SPANS).replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + f",\n{_REASONED}\n{body}"


@query(revised_sql("SELECT document, id, result FROM f"))
def fix_apply(spark, sf_dir):
    """Revisions applied in order to the spans of their targets, each with its result."""
    return applied(revisions_of(spark, sf_dir), V.spans(spark, sf_dir).select(F.col("unit_id").alias("target"), F.col("span_id").alias("span")))


@query(revised_sql("SELECT document, result, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM f WHERE result <> 'applied' GROUP BY 1, 2"))
def rejected_fixes(spark, sf_dir):
    """Revisions that weren't applied, by document and reason."""
    g = fix_apply(spark, sf_dir).where("result <> 'applied'").groupBy("document", "result").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("id")).alias("x"))
    return g.select("document", "result", "n", F.array_join(F.transform("x", lambda x: x.cast("string")), ",").alias("ids"))
