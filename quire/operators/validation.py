"""Constraint checks that give violations as rows, repairs, the policies of the agent, and rendering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.plans.registry import query
from quire.sources import views as V
from quire.sources.views import CELLS, SPANS, UNITS, sql


def violations(df: DataFrame, rules: dict[str, Column], *keys: str) -> DataFrame:
    """(keys, rule): one row for each rule that a row breaks; all rules in one pass."""
    broken = F.array_compact(F.array(*[F.when(broken, rule) for rule, broken in rules.items()]))
    return df.select(*keys, F.explode(broken).alias("rule"))


LINT = {
    "duplicate_text": "dup > 1",
    "missing_content": "length(text) < 5",
    "unordered": "prev IS NOT NULL AND prev > page",
    "unsafe": "contains(text, '@')",
}


LINTED = "(SELECT *, count(*) OVER (PARTITION BY doc_id, text) AS dup, lag(page) OVER (PARTITION BY doc_id ORDER BY ord) AS prev FROM v_units)"


@query(sql(" UNION ALL ".join(f"SELECT unit_id, '{r}' AS rule FROM {LINTED} WHERE {e}" for r, e in LINT.items()), *UNITS))
def lint_report(spark, sf_dir):
    w = Window.partitionBy("doc_id")
    u = V.units(spark, sf_dir).withColumn("dup", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "text"))).withColumn("prev", F.lag("page").over(w.orderBy("ord")))
    return violations(u, {r: F.expr(e) for r, e in LINT.items()}, "unit_id")


BLOCK_LINT = {
    "page_order": "prev_page > page",
    "block_order": "prev_place >= place",
    "duplicate_id": "same_id > 1",
    "missing_content": "kind NOT IN ('figure', 'table', 'horizontal_rule') AND content IS NULL",
    "missing_level": "kind = 'heading' AND level IS NULL",
    "missing_alert_kind": "kind = 'alert' AND alert_kind IS NULL",
    "missing_image": "kind = 'figure' AND image IS NULL",
    "missing_cells": "kind = 'table' AND n_cells = 0",
    "overlapping_cell": "kind = 'table' AND n_cells > n_places",
    "empty_unit": "trim(content) = ''",
}
BLOCK_FIELDS = {
    "id": "CASE WHEN k % 23 = 0 THEN doc_id || '/first' ELSE unit_id END",
    "kind": "CASE k % 9 WHEN 0 THEN 'heading' WHEN 1 THEN 'figure' WHEN 2 THEN 'table' WHEN 3 THEN 'alert' WHEN 4 THEN 'horizontal_rule' WHEN 5 THEN 'list_item' WHEN 6 THEN 'formula' ELSE 'paragraph' END",
    "page": "page - CASE WHEN k % 29 = 0 THEN 1 ELSE 0 END",
    "place": "ord - CASE WHEN k % 19 = 0 THEN 1 ELSE 0 END",
    "content": "CASE WHEN k % 17 = 0 THEN NULL WHEN k % 13 = 0 THEN ' ' ELSE text END",
    "level": "CASE WHEN k % 2 = 0 THEN k % 6 + 1 END",
    "alert_kind": "CASE WHEN k % 4 <> 0 THEN 'note' END",
    "image": "CASE WHEN k % 5 <> 0 THEN 'i' || k END",
    "n_cells": "k % 4",
    "n_places": "CASE WHEN k % 7 = 0 THEN k % 4 - 1 ELSE k % 4 END",
}
_BLOCKS = "SELECT doc_id, ord, unit_id, " + ", ".join(f"{e} AS {n}" for n, e in BLOCK_FIELDS.items()) + " FROM (SELECT *, doc_id * 31 + ord AS k FROM v_units)"
_LINKED = f"SELECT *, lag(page) OVER (PARTITION BY doc_id ORDER BY ord) AS prev_page, lag(place) OVER (PARTITION BY doc_id, page ORDER BY ord) AS prev_place, count(*) OVER (PARTITION BY doc_id, id) AS same_id FROM ({_BLOCKS})"


@query(sql(" UNION ALL ".join(f"SELECT unit_id, '{r}' AS rule FROM ({_LINKED}) WHERE {e}" for r, e in BLOCK_LINT.items()), *UNITS))
def lint_blocks(spark, sf_dir):
    """Blocks that break a rule of publication: order of pages and blocks, ids, and what each kind must have."""
    u = V.units(spark, sf_dir).withColumn("k", F.col("doc_id") * 31 + F.col("ord"))
    b = u.select("doc_id", "ord", "unit_id", *[F.expr(e).alias(n) for n, e in BLOCK_FIELDS.items()])
    b = b.withColumn("prev_page", F.lag("page").over(Window.partitionBy("doc_id").orderBy("ord"))).withColumn("prev_place", F.lag("place").over(Window.partitionBy("doc_id", "page").orderBy("ord")))
    b = b.withColumn("same_id", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "id")))
    return violations(b, {r: F.coalesce(F.expr(e), F.lit(False)) for r, e in BLOCK_LINT.items()}, "unit_id")


@query(sql("SELECT event_id, unnest(list_filter([CASE WHEN n <> 1 THEN 'not once' END, CASE WHEN status = 'failed' AND tokens > 100 THEN 'kind and side' END, CASE WHEN tokens % 10 = 0 THEN 'empty summary' END, CASE WHEN round > 15 THEN 'unknown id' END], lambda x: x IS NOT NULL)) AS rule FROM (SELECT *, count(*) OVER (PARTITION BY task, round, operation) AS n FROM v_calls)", "v_calls"))
def diff_violations(spark, sf_dir):
    """Each selected id exactly once, kinds that fit their sides, summaries that aren't empty."""
    c = V.calls(spark, sf_dir).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("task", "round", "operation")))
    return violations(c, {"not once": F.col("n") != 1, "kind and side": F.expr("status = 'failed' AND tokens > 100"), "empty summary": F.col("tokens") % 10 == 0, "unknown id": F.col("round") > 15}, "event_id")


@query(sql("SELECT a.unit_id, CASE WHEN b.unit_id IS NULL AND a.kind = 'heading' THEN 'no reason' WHEN b.unit_id IS NULL THEN 'unmatched' ELSE 'kind differs' END AS rule FROM v_v2 a LEFT JOIN v_tr b USING (unit_id) WHERE b.unit_id IS NULL OR (a.kind <> b.kind) OR length(b.text) < 12", *UNITS, "v_v2", "v_tr"))
def alignment_violations(spark, sf_dir):
    b = V.translation(spark, sf_dir).select("unit_id", F.col("kind").alias("k"), F.col("text").alias("t"))
    j = V.version2(spark, sf_dir).join(b, "unit_id", "left")
    rule = F.when(F.col("k").isNull() & (F.col("kind") == "heading"), "no reason").when(F.col("k").isNull(), "unmatched").otherwise("kind differs")
    return j.where("k IS NULL OR kind <> k OR length(t) < 12").select("unit_id", rule.alias("rule"))


@query("SELECT l.doc_id, unnest(list_filter([CASE WHEN l.quality = 1 AND l.toxic = 1 THEN 'correct with an issue' END, CASE WHEN d.doc_id IS NULL THEN 'unknown target' END, CASE WHEN l.quality = 0 AND length(d.text) < 200 THEN 'no category' END], lambda x: x IS NOT NULL)) AS rule FROM labels l LEFT JOIN documents d USING (doc_id)")
def review_violations(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))
    j = V.table(spark, sf_dir, "labels").join(d, "doc_id", "left")
    return violations(j, {"correct with an issue": F.expr("quality = 1 AND toxic = 1"), "unknown target": F.col("n").isNull(), "no category": F.expr("quality = 0 AND n < 200")}, "doc_id")


@query(sql("SELECT span_id, CASE WHEN regexp_replace(source, '[.]+', '', 'g') = regexp_replace(coalesce(revised, source), '[.]+', '', 'g') THEN 'leaders only' WHEN lower(source) = revised THEN 'case only' ELSE 'issue' END AS verdict FROM v_spans WHERE revised IS NOT NULL", *SPANS))
def suppress_findings(spark, sf_dir):
    """Findings that are none: edits of leader dots or of letter case alone."""
    bare = lambda c: F.regexp_replace(c, "[.]+", "")
    verdict = F.when(bare(F.col("source")) == bare(F.coalesce("revised", "source")), "leaders only").when(F.lower("source") == F.col("revised"), "case only").otherwise("issue")
    return V.spans(spark, sf_dir).where("revised IS NOT NULL").select("span_id", verdict.alias("verdict"))


@query(sql("SELECT u.unit_id, 'heading' AS kind FROM v_units u WHERE kind = 'heading' AND NOT EXISTS (SELECT 1 FROM v_v2 p WHERE p.unit_id = u.unit_id) UNION ALL SELECT 't' || tab, 'table' FROM (SELECT tab FROM v_cells WHERE col = 0 AND NOT header GROUP BY 1 HAVING count(*) = 1) WHERE tab % 5 = 0", *UNITS, "v_v2", *CELLS))
def structure_missing(spark, sf_dir):
    """Headings and tables of one cell (here of one row) that a response didn't classify."""
    headings = V.units(spark, sf_dir).where("kind = 'heading'").join(V.version2(spark, sf_dir), "unit_id", "left_anti").select("unit_id", F.lit("heading").alias("kind"))
    single = V.cells(spark, sf_dir).where("col = 0 AND NOT header").groupBy("tab").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    return headings.unionByName(single.where("tab % 5 = 0").select(F.concat(F.lit("t"), "tab").alias("unit_id"), F.lit("table").alias("kind")))


#: An action names ids of both roles; its rules over (n, roles, ops, unknown, outside, done, pending).
ACTION = {
    "no ids": "n = 0", "too many ids": "n > 4", "too many of a role": "most > 3", "several operations": "ops > 1", "unknown id": "unknown > 0", "outside its targets": "outside > 0", "finish too early": "done AND pending > 0",
}
ACTION_STATE = {
    "n": "count(CASE WHEN tokens >= 5 THEN 1 END)", "most": "greatest(count(CASE WHEN event_id % 2 = 0 THEN 1 END), count(CASE WHEN event_id % 2 = 1 THEN 1 END))", "ops": "count(DISTINCT operation)",
    "unknown": "count(CASE WHEN event_id % 23 = 0 THEN 1 END)", "outside": "count(CASE WHEN operation = 'recheck' AND event_id % 9 = 8 THEN 1 END)", "done": "bool_or(status = 'succeeded')", "pending": "count(CASE WHEN status = 'processing' THEN 1 END)",
}


@query(sql(" UNION ALL ".join(f"SELECT task, round, '{rule}' AS rule FROM (SELECT task, round, {', '.join(f'{e} AS {n}' for n, e in ACTION_STATE.items())} FROM v_calls GROUP BY 1, 2) WHERE {e}" for rule, e in ACTION.items()), "v_calls"))
def action_violations(spark, sf_dir):
    """Actions that break a rule: how many ids, in all and of a role, one operation, known ids within the targets, no end while something is pending."""
    g = V.calls(spark, sf_dir).groupBy("task", "round").agg(*[F.expr(e).alias(n) for n, e in ACTION_STATE.items()])
    return violations(g, {rule: F.expr(e) for rule, e in ACTION.items()}, "task", "round")


@query(sql("SELECT path, CASE WHEN size <= 0 THEN 'size' WHEN NOT regexp_matches(sha, '^[0-9a-f]{64}$') THEN 'sha256' WHEN lower(path) NOT LIKE '%.pdf' THEN 'suffix' END AS rule FROM v_files WHERE size <= 0 OR NOT regexp_matches(sha, '^[0-9a-f]{64}$') OR lower(path) NOT LIKE '%.pdf'", "v_files"))
def manifest_violations(spark, sf_dir):
    f = V.files(spark, sf_dir)
    rule = F.when(F.col("size") <= 0, "size").when(~F.col("sha").rlike("^[0-9a-f]{64}$"), "sha256").when(~F.lower("path").endswith(".pdf"), "suffix")
    return f.select("path", rule.alias("rule")).where("rule IS NOT NULL")


# ---- the agent's fall-back policies --------------------------------------------------------------

#: Ids of an action, and of a recheck or an evaluation.
MAX_IDS, MAX_EACH = 32, 8
COUNTS = {
    "conflicts": "status = 'failed'", "unchecked": "status = 'partial'", "pending": "status = 'processing' AND event_id % 2 = 0", "other_pending": "status = 'processing' AND event_id % 2 = 1",
    "unmatched": "status = 'succeeded' AND event_type = 'purchase'", "other_unmatched": "status = 'succeeded' AND event_type <> 'purchase'",
}
STATE = "SELECT task, " + ", ".join(f"count(*) FILTER (WHERE {e}) AS {n}" for n, e in COUNTS.items()) + " FROM (SELECT *, max(round) OVER (PARTITION BY task) AS last FROM v_calls) WHERE round = last GROUP BY 1"


def task_state(spark, sf_dir) -> DataFrame:
    """What the last round of each task left in each role: conflicts, unchecked and pending units, units without a match."""
    rounds = V.calls(spark, sf_dir).groupBy("task", "round").agg(*[F.count_if(F.expr(e)).alias(n) for n, e in COUNTS.items()])
    return rounds.groupBy("task").agg(F.max_by(F.struct(*COUNTS), "round").alias("s")).select("task", "s.*")


REVIEW = {
    "conflicts > 0": ("recheck", f"least({MAX_EACH}, conflicts)"),
    "unchecked > 0": ("evaluate", f"least({MAX_EACH}, unchecked)"),
    "pending + other_pending > 0": ("match", f"least({MAX_IDS // 2}, pending) + least({MAX_IDS // 2}, other_pending)"),
    "unmatched > 0 AND other_unmatched > 0": ("match", f"least({MAX_IDS // 2}, unmatched) + least({MAX_IDS // 2}, other_unmatched)"),
}
UPGRADE = {"pending + other_pending > 0": ("evaluate", " + ".join(f"least({MAX_IDS // 3}, {n})" for n in ("pending", "other_pending", "other_unmatched")))}


def policy(rules: dict) -> str:
    """The first rule that holds, as SQL; else the end."""
    pick = lambda i: "CASE " + " ".join(f"WHEN {when} THEN {x}" for when, x in ((w, (f"'{r[0]}'", r[1])[i]) for w, r in rules.items())) + (" ELSE 'finish' END", " ELSE 0 END")[i]
    return f"{pick(0)} AS action, {pick(1)} AS ids"


@query(sql(f"SELECT task, {policy(REVIEW)} FROM ({STATE})", "v_calls"))
def next_action_review(spark, sf_dir):
    """Conflicts first, then what is unchecked, then what is pending, then what has no match on either side; else the end."""
    return task_state(spark, sf_dir).selectExpr("task", *policy(REVIEW).replace(" AS action, ", " AS action\n").split("\n"))


@query(sql(f"SELECT task, {policy(UPGRADE)} FROM ({STATE})", "v_calls"))
def next_action_upgrade(spark, sf_dir):
    """What is pending, up to a third of the ids in each role, with candidates of the translation; else the end."""
    return task_state(spark, sf_dir).selectExpr("task", *policy(UPGRADE).replace(" AS action, ", " AS action\n").split("\n"))


# ---- ids -----------------------------------------------------------------------------------------


@query(sql("SELECT event_id, 'call-' || sha256(task || '|' || operation || '|' || round || '|' || tokens) AS call FROM v_calls", "v_calls"))
def call_ids(spark, sf_dir):
    """Deterministic ids of calls."""
    return V.calls(spark, sf_dir).select("event_id", F.concat(F.lit("call-"), F.sha2(F.concat_ws("|", "task", "operation", "round", "tokens"), 256)).alias("call"))


@query(sql("SELECT doc_id, sha256(string_agg(sha256(text), '' ORDER BY ord)) AS revision FROM v_units GROUP BY 1", *UNITS))
def revision_hash(spark, sf_dir):
    """One hash of a document's units in order."""
    h = F.transform(F.sort_array(F.collect_list(F.struct("ord", F.sha2("text", 256).alias("h")))), lambda x: x["h"])
    return V.units(spark, sf_dir).groupBy("doc_id").agg(F.sha2(F.array_join(h, ""), 256).alias("revision"))


# ---- rendering -----------------------------------------------------------------------------------

MARKS = (("bold", "**"), ("italic", "*"), ("strike", "~~"))


def escaped(c: Column) -> Column:
    """Signs that Markdown reads as its own, with a backslash."""
    return F.regexp_replace(c, r"([\\`*_\[\]<>#|])", r"\\$1")


def coded(c: Column) -> Column:
    """Inline code between fences longer than any run of back-ticks in it."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit("`+"), F.lit(0)), F.length)), F.lit(0))
    fence = F.repeat(F.lit("`"), longest + 1)
    space = F.when(longest > 0, " ").otherwise("")
    return F.concat(fence, space, c, space, fence)


def inline() -> Column:
    """A span as Markdown: code as code, else escaped, wrapped by its marks in order and linked to its unit if it is a link."""
    wrapped = reduce(lambda t, m: F.when(F.col(m[0]), F.concat(F.lit(m[1]), t, F.lit(m[1]))).otherwise(t), MARKS, escaped(F.col("source")))
    link = F.concat(F.lit("["), wrapped, F.lit("](<#u%20"), F.col("unit_id"), F.lit(">)"))
    return F.when(F.col("kind") == "code", coded(F.col("source"))).when(F.col("kind") == "line_break", "\n").when(F.col("kind") == "link", link).otherwise(wrapped)


ESC = r"regexp_replace(source, '([\\`*_\[\]<>#|])', '\\\1', 'g')"
for _flag, _mark in MARKS:
    ESC = f"CASE WHEN {_flag} THEN '{_mark}' || {ESC} || '{_mark}' ELSE {ESC} END"
RUN = "coalesce(list_max(list_transform(regexp_extract_all(source, '`+'), lambda x: length(x))), 0)"
CODE = f"repeat('`', {RUN} + 1) || CASE WHEN {RUN} > 0 THEN ' ' ELSE '' END || source || CASE WHEN {RUN} > 0 THEN ' ' ELSE '' END || repeat('`', {RUN} + 1)"
INLINE = f"CASE kind WHEN 'code' THEN {CODE} WHEN 'line_break' THEN chr(10) WHEN 'link' THEN '[' || {ESC} || '](<#u%20' || unit_id || '>)' ELSE {ESC} END"


@query(sql(f"SELECT span_id, {INLINE} AS markdown FROM v_spans", *SPANS))
def markdown_inline(spark, sf_dir):
    return V.spans(spark, sf_dir).select("span_id", inline().alias("markdown"))


@query(sql("SELECT tab, string_agg(line, chr(10) ORDER BY row) AS markdown FROM (SELECT tab, row, '| ' || string_agg(replace(text, '|', '/'), ' | ' ORDER BY col) || ' |' AS line FROM v_cells GROUP BY 1, 2) GROUP BY 1", *CELLS))
def markdown_table(spark, sf_dir):
    """A table as lines of cells between bars."""
    line = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", F.replace("text", F.lit("|"), F.lit("/")).alias("t")))), lambda x: x["t"]), " | ")
    rows = V.cells(spark, sf_dir).groupBy("tab", "row").agg(F.concat(F.lit("| "), line, F.lit(" |")).alias("line"))
    return rows.groupBy("tab").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("markdown"))


@query(sql("SELECT doc_id, string_agg(CASE kind WHEN 'heading' THEN '# ' || text WHEN 'list_item' THEN '- ' || text ELSE text END, chr(10) || chr(10) ORDER BY ord) AS markdown FROM v_units GROUP BY 1", *UNITS))
def markdown_document(spark, sf_dir):
    """A document as Markdown: blocks in order, a blank line between them."""
    block = F.when(F.col("kind") == "heading", F.concat(F.lit("# "), "text")).when(F.col("kind") == "list_item", F.concat(F.lit("- "), "text")).otherwise(F.col("text"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("ord", block.alias("b")))), lambda x: x["b"])
    return V.units(spark, sf_dir).groupBy("doc_id").agg(F.array_join(parts, "\n\n").alias("markdown"))


@query(sql("SELECT doc_id, string_agg('[' || unit_id || ']' || chr(10) || text, chr(10) ORDER BY ord) AS shown FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM v_units) WHERE k <= 3 GROUP BY 1", *UNITS))
def comparison_text(spark, sf_dir):
    """The first three items with their ids."""
    u = V.units(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))).where("k <= 3")
    item = F.concat(F.lit("["), F.col("unit_id"), F.lit("]\n"), F.col("text")).alias("t")
    return u.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", item))), lambda x: x["t"]), "\n").alias("shown"))


@query(sql("SELECT unit_id, u.text AS before, v.text AS after FROM v_units u JOIN v_v2 v USING (unit_id) WHERE u.text <> v.text", *UNITS, "v_v2"))
def before_after(spark, sf_dir):
    """Changed units before and after."""
    v = V.version2(spark, sf_dir).select("unit_id", F.col("text").alias("after"))
    return V.units(spark, sf_dir).select("unit_id", F.col("text").alias("before")).join(v, "unit_id").where("before <> after")


@query(sql("SELECT unit_id, coalesce(r.text, m.text) AS text, r.text IS NOT NULL AS from_result FROM (SELECT unit_id, text FROM v_v2 WHERE ord % 2 = 0) r FULL JOIN (SELECT unit_id, text FROM v_tr WHERE ord % 3 = 0) m USING (unit_id)", *UNITS, "v_v2", "v_tr"))
def review_target_lookup(spark, sf_dir):
    """Targets from the result, or where it has none from the calls."""
    r = V.version2(spark, sf_dir).where("ord % 2 = 0").select("unit_id", F.col("text").alias("r"))
    m = V.translation(spark, sf_dir).where("ord % 3 = 0").select("unit_id", F.col("text").alias("m"))
    return r.join(m, "unit_id", "full_outer").select("unit_id", F.coalesce("r", "m").alias("text"), F.col("r").isNotNull().alias("from_result"))
