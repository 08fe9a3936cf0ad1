"""The agent's loop and what it answers: when it stops, what it is shown, which answers break a rule."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import rules as R
from quire.operators.texts import gsub, has
from quire.operators.validation import violations
from quire.plans.registry import query
from quire.sources import views as V
from quire.sources.views import MARKED, SPANS, UNITS, sql

#: Calls without progress, of the same kind without progress, and failures of a kind that end the loop.
IDLE, SAME, FAILED = 12, 3, 3


@query(sql(f"""SELECT task, min(event_id) AS event_id, arg_min(reason, event_id) AS reason FROM (
SELECT task, event_id, CASE WHEN idle >= {IDLE} THEN 'idle' WHEN same >= {SAME} THEN 'same action' WHEN fails >= {FAILED} THEN 'failures' END AS reason FROM (
SELECT task, event_id, count(*) FILTER (WHERE NOT ok) OVER (PARTITION BY task, g ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS idle, count(*) FILTER (WHERE NOT ok) OVER (PARTITION BY task, h ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS same,
count(*) FILTER (WHERE status = 'failed') OVER (PARTITION BY task, operation, o ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS fails FROM (
SELECT *, sum(ok::INT) OVER (PARTITION BY task ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS g, sum(brk) OVER (PARTITION BY task ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS h, sum(ok::INT) OVER (PARTITION BY task, operation ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS o FROM (
SELECT *, CASE WHEN ok OR lag(ok) OVER w OR lag(operation) OVER w <> operation THEN 1 ELSE 0 END AS brk FROM (SELECT *, status = 'succeeded' AS ok FROM v_calls) WINDOW w AS (PARTITION BY task ORDER BY event_id))))) WHERE reason IS NOT NULL GROUP BY 1""", "v_calls"))  # fmt: skip
def agent_stops(spark, sf_dir):
    """Where a task's loop ends for want of progress, and why: idle calls, the same action again and again, failures of an action.

    Each counter begins anew after progress: groups between successes, counted within."""
    w = Window.partitionBy("task").orderBy("event_id")
    ok = F.col("status") == "succeeded"
    brk = ok | F.coalesce(F.lag(ok).over(w), F.lit(False)) | F.coalesce(F.lag("operation").over(w) != F.col("operation"), F.lit(False))
    c = V.calls(spark, sf_dir).select("task", "event_id", "operation", "status", ok.alias("ok"), brk.cast("int").alias("brk"))
    run = lambda what, *by: F.sum(what).over(Window.partitionBy("task", *by).orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    c = c.withColumn("g", run(F.col("ok").cast("int"))).withColumn("h", run("brk")).withColumn("o", run(F.col("ok").cast("int"), "operation"))
    idle, failed = (~F.col("ok")).cast("int"), (F.col("status") == "failed").cast("int")
    reason = F.when(run(idle, "g") >= IDLE, "idle").when(run(idle, "h") >= SAME, "same action").when(run(failed, "operation", "o") >= FAILED, "failures")
    stops = c.select("task", "event_id", reason.alias("reason")).where("reason IS NOT NULL")
    return stops.groupBy("task").agg(F.min("event_id").alias("event_id"), F.min_by("reason", "event_id").alias("reason"))


#: What the agent is shown of a task: which calls, how many, and whether the last ones.
SHOWN = {"pending": ("status = 'processing'", 8, False), "unchecked": ("status = 'partial'", 32, False), "reviewed": ("status = 'succeeded'", 8, True), "observed": ("operation = 'match'", 5, False), "compared": ("operation = 'evaluate'", 3, False)}


@query(sql("SELECT task, list, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM (" + " UNION ALL ".join(f"SELECT * FROM (SELECT task, '{name}' AS list, event_id, row_number() OVER (PARTITION BY task ORDER BY event_id {'DESC' if last else ''}) AS k FROM v_calls WHERE {which}) WHERE k <= {most}" for name, (which, most, last) in SHOWN.items()) + ") GROUP BY 1, 2", "v_calls"))
def agent_lists(spark, sf_dir):
    """Prefixes of a task's lists: 8 pending, 32 unchecked, the last 8 reviewed, 5 observed, 3 compared."""
    names = F.array_compact(F.array(*[F.when(F.expr(which), F.struct(F.lit(name).alias("list"), F.lit(most).alias("most"), (F.col("event_id") * (-1 if last else 1)).alias("at"))) for name, (which, most, last) in SHOWN.items()]))
    each = V.calls(spark, sf_dir).select("task", "event_id", F.explode(names).alias("x")).select("task", "event_id", "x.*")
    kept = each.withColumn("k", F.row_number().over(Window.partitionBy("task", "list").orderBy("at"))).where("k <= most")
    return kept.groupBy("task", "list").agg(F.array_join(F.transform(F.sort_array(F.collect_list("event_id")), lambda x: x.cast("string")), ",").alias("ids"))


ANSWERS = {
    "selected": "k % 3 <> 0",
    "times": "CASE WHEN k % 9 = 1 THEN 0 WHEN k % 23 = 0 THEN 2 ELSE 1 END",
    "has_old": "k % 5 <> 0",
    "has_new": "k % 4 <> 0",
    "claimed": "CASE WHEN k % 17 = 0 THEN 'changed' WHEN k % 5 = 0 THEN 'added' WHEN k % 4 = 0 THEN 'deleted' ELSE 'changed' END",
    "summary": "CASE WHEN k % 19 = 0 THEN ' ' ELSE text END",
    "named": "concat(doc_id, '/', ord - CASE WHEN k % 29 = 0 THEN 1 ELSE 0 END)",
}
ANSWER_RULES = {
    "missing id": "selected AND times = 0",
    "repeated id": "times > 1",
    "unknown id": "NOT selected AND times > 0",
    "kind and sides": "times > 0 AND claimed <> CASE WHEN has_old AND has_new THEN 'changed' WHEN has_old THEN 'deleted' ELSE 'added' END",
    "empty summary": "times > 0 AND trim(summary) = ''",
    "unknown translation": "times > 0 AND NOT known",
    "repeated translation": "times > 0 AND same > 1",
}
_ANSWERED = "SELECT unit_id, doc_id, " + ", ".join(f"{e} AS {n}" for n, e in ANSWERS.items()) + " FROM (SELECT *, doc_id * 31 + ord AS k FROM v_units)"


@query(sql(" UNION ALL ".join(f"SELECT unit_id, '{rule}' AS rule FROM answered WHERE {e}" for rule, e in ANSWER_RULES.items()), *UNITS, "v_tr").replace("\nSELECT unit_id, 'missing id'", f",\nanswered AS (SELECT a.*, t.unit_id IS NOT NULL AS known, count(*) OVER (PARTITION BY a.doc_id, named) AS same FROM ({_ANSWERED}) a LEFT JOIN v_tr t ON t.unit_id = a.named)\nSELECT unit_id, 'missing id'", 1))
def change_answers(spark, sf_dir):
    """Answers about changes that break a rule: each id asked for once, a kind that fits its sides, a summary, known translations once each."""
    u = V.units(spark, sf_dir).withColumn("k", F.col("doc_id") * 31 + F.col("ord"))
    a = u.select("unit_id", "doc_id", *[F.expr(e).alias(n) for n, e in ANSWERS.items()])
    known = V.translation(spark, sf_dir).select(F.col("unit_id").alias("named"), F.lit(True).alias("known"))
    a = a.join(known, "named", "left").withColumn("known", F.coalesce("known", F.lit(False))).withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "named")))
    return violations(a, {rule: F.expr(e) for rule, e in ANSWER_RULES.items()}, "unit_id")


EDITED = "CASE WHEN k % 5 = 0 THEN raw || ' x' WHEN k % 14 = 6 THEN replace(raw, '-', '/') WHEN k % 14 = 9 THEN replace(raw, ' ', '') WHEN k % 14 = 5 THEN {} ELSE raw END"


def _day_sql(x: str) -> str:
    bare = gsub(x, r"\s+")
    return f"CASE WHEN {has(bare, R.DATE)} THEN try_cast({gsub(bare, R.DATE, chr(92) + '1-' + chr(92) + '2-' + chr(92) + '3')} AS DATE) END"


def _ref_sql(x: str) -> str:
    return f"CASE WHEN {has(x, R.PAGE_REF)} THEN {gsub(x, R.PAGE_REF, chr(92) + '1 ' + chr(92) + '2')} END"


def _bare_sql(x: str) -> str:
    return f"trim({gsub(x, '[.]{2,}')})"


@query(sql(f"""SELECT unit_id, CASE WHEN raw = edit THEN 'same text' WHEN {_day_sql('raw')} = {_day_sql('edit')} THEN 'same day' WHEN {_ref_sql('raw')} = {_ref_sql('edit')} THEN 'same page' WHEN {_bare_sql('raw')} = {_bare_sql('edit')} THEN 'leaders only' ELSE 'issue' END AS verdict
FROM (SELECT unit_id, raw, {EDITED.format(gsub('raw', '[.]{2,}'))} AS edit FROM v_marked)""", *MARKED))  # fmt: skip
def no_findings(spark, sf_dir):
    """Edits that are no findings: the same text, the same day written otherwise, the same page reference, leader dots alone."""
    m = V.marked(spark, sf_dir)
    k, raw = F.col("k"), F.col("raw")
    leaders = lambda c: F.regexp_replace(c, "[.]{2,}", "")
    edit = F.when(k % 5 == 0, F.concat(raw, F.lit(" x"))).when(k % 14 == 6, F.replace(raw, F.lit("-"), F.lit("/"))).when(k % 14 == 9, F.replace(raw, F.lit(" "), F.lit(""))).when(k % 14 == 5, leaders(raw)).otherwise(raw)
    m = m.withColumn("edit", edit)
    e = F.col("edit")
    verdict = F.when(raw == e, "same text").when(R.date_value(raw) == R.date_value(e), "same day").when(R.page_ref(raw) == R.page_ref(e), "same page").when(F.trim(leaders(raw)) == F.trim(leaders(e)), "leaders only").otherwise("issue")
    return m.select("unit_id", verdict.alias("verdict"))


CLAIMS = """SELECT o.id AS owner, o.id + o.id % 3 AS caption, CASE WHEN o.label = 'text' THEN 'no table or figure' WHEN o.id % 3 = 0 THEN 'itself' WHEN c.id IS NULL THEN 'unknown' WHEN c.label <> 'text' THEN 'no text' WHEN c.id % 10 = 3 THEN 'heading' WHEN o.id % 13 = 0 THEN 'there already' END AS why
FROM v_boxes o LEFT JOIN v_boxes c ON c.id = o.id + o.id % 3"""


@query(sql(f"SELECT owner, caption, coalesce(why, CASE WHEN row_number() OVER (PARTITION BY caption, why IS NULL ORDER BY owner) > 1 THEN 'used before' ELSE 'moved' END) AS result FROM ({CLAIMS})", "v_boxes"))
def caption_moves(spark, sf_dir):
    """Claims of a text as caption, and what becomes of each: tables and figures only, not itself, no heading, not twice."""
    b = V.boxes(spark, sf_dir).select("id", "label")
    claims = b.select(F.col("id").alias("owner"), F.col("label").alias("kind"), (F.col("id") + F.col("id") % 3).alias("caption"))
    j = claims.join(b.select(F.col("id").alias("caption"), "label"), "caption", "left")
    o, c = F.col("owner"), F.col("caption")
    why = F.when(F.col("kind") == "text", "no table or figure").when(o % 3 == 0, "itself").when(F.col("label").isNull(), "unknown").when(F.col("label") != "text", "no text").when(c % 10 == 3, "heading").when(o % 13 == 0, "there already")
    j = j.withColumn("why", why)
    place = F.row_number().over(Window.partitionBy("caption", F.col("why").isNull()).orderBy("owner"))
    return j.select("owner", "caption", F.coalesce("why", F.when(place > 1, "used before").otherwise("moved")).alias("result"))


@query(sql(f"""SELECT unit_id, CASE WHEN {has('raw', R.NUMBERED)} THEN least(6, length(n) - length(replace(n, '.', '')) + 1)::INT WHEN given = 1 AND base > 1 AND seen AND page > first AND NOT {has('raw', R.TOP_LEVEL)} THEN base ELSE given END AS level FROM (
SELECT *, regexp_extract(raw, '{R.NUMBERED}', 1) AS n, (1 + k % 3)::INT AS base, CASE WHEN k % 2 = 0 THEN 1 ELSE (1 + k % 3)::INT END AS given, ord // 10 AS page, min(ord // 10) OVER (PARTITION BY doc_id) AS first,
count(*) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS seen FROM v_marked)""", *MARKED))  # fmt: skip
def heading_baselines(spark, sf_dir):
    """Levels of headings: of numbered ones by their dots; a first level on a later page falls back to its baseline unless it begins a chapter."""
    k, raw, base = F.col("k"), F.col("raw"), (1 + F.col("k") % 3).cast("int")
    page = F.floor(F.col("ord") / 10)
    given = F.when(k % 2 == 0, 1).otherwise(base)
    by = Window.partitionBy("doc_id")
    seen = F.count(F.lit(1)).over(by.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)) > 0
    back = (given == 1) & (base > 1) & seen & (page > F.min(page).over(by)) & ~raw.rlike(R.TOP_LEVEL)
    level = F.when(raw.rlike(R.NUMBERED), F.least(F.lit(6), R.heading_depth(raw))).when(back, base).otherwise(given)
    return V.marked(spark, sf_dir).select("unit_id", level.cast("int").alias("level"))


def broken(answered: str, rules: dict[str, str], key: str, *views: str) -> str:
    """SQL: a row for each rule that an answer breaks."""
    return sql(" UNION ALL ".join(f"SELECT {key}, '{rule}' AS rule FROM ({answered}) WHERE {e}" for rule, e in rules.items()), *views)


PAIRS = {
    "claimed": "CASE WHEN k % 17 = 0 THEN 'match' WHEN k % 5 = 0 THEN 'source only' ELSE 'match' END",
    "named": "CASE WHEN k % 5 <> 0 THEN concat(doc_id, '/', ord - CASE WHEN k % 29 = 0 THEN 1 ELSE 0 END) END",
    "reason": "CASE WHEN k % 10 = 0 THEN ' ' ELSE 'no counterpart' END",
    "times": "CASE WHEN k % 9 = 1 THEN 0 WHEN k % 23 = 0 THEN 2 ELSE 1 END",
}
PAIR_RULES = {
    "missing id": "times = 0",
    "repeated id": "times > 1",
    "kind and sides": "times > 0 AND (claimed = 'match') <> (named IS NOT NULL)",
    "no reason": "times > 0 AND claimed <> 'match' AND trim(reason) = ''",
    "unknown translation": "times > 0 AND named IS NOT NULL AND NOT known",
    "repeated translation": "times > 0 AND named IS NOT NULL AND same > 1",
}
_PAIRED = "SELECT a.*, t.unit_id IS NOT NULL AS known, count(*) OVER (PARTITION BY a.doc_id, named) AS same FROM (SELECT unit_id, doc_id, " + ", ".join(f"{e} AS {n}" for n, e in PAIRS.items()) + " FROM (SELECT *, doc_id * 31 + ord AS k FROM v_units)) a LEFT JOIN v_tr t ON t.unit_id = a.named"


@query(broken(_PAIRED, PAIR_RULES, "unit_id", *UNITS, "v_tr"))
def alignment_answers(spark, sf_dir):
    """Answers about alignment that break a rule: each unit once, known translations once each, kinds that fit their sides, a reason where there is no match."""
    u = V.units(spark, sf_dir).withColumn("k", F.col("doc_id") * 31 + F.col("ord"))
    a = u.select("unit_id", "doc_id", *[F.expr(e).alias(n) for n, e in PAIRS.items()])
    known = V.translation(spark, sf_dir).select(F.col("unit_id").alias("named"), F.lit(True).alias("known"))
    a = a.join(known, "named", "left").withColumn("known", F.coalesce("known", F.lit(False))).withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "named")))
    return violations(a, {rule: F.expr(e) for rule, e in PAIR_RULES.items()}, "unit_id")


REVIEWED = {
    "verdict": "CASE WHEN m % 2 = 0 THEN 'correct' ELSE 'issue' END",
    "category": "CASE WHEN m % 10 <> 1 THEN 'wording' END",
    "severity": "CASE WHEN m % 6 <> 1 THEN 'minor' END",
    "edit": "CASE WHEN m % 7 = 0 THEN lower(source) WHEN m % 8 = 0 THEN replace(source, ' ', '  ') WHEN m % 9 = 0 THEN concat(prev, source) WHEN m % 11 = 0 THEN concat(source, next) END",
    "times": "CASE WHEN m % 13 = 1 THEN 0 WHEN m % 19 = 0 THEN 2 ELSE 1 END",
}
REVIEW_RULES = {
    "missing id": "times = 0",
    "repeated id": "times > 1",
    "correct with an edit": "times > 0 AND verdict = 'correct' AND edit IS NOT NULL",
    "no category": "times > 0 AND verdict = 'issue' AND category IS NULL",
    "no severity": "times > 0 AND verdict = 'issue' AND severity IS NULL",
    "code edited": "times > 0 AND kind IN ('code', 'line_break') AND edit IS NOT NULL",
    "white space only": "times > 0 AND edit <> source AND replace(edit, ' ', '') = replace(source, ' ', '')",
    "copies the one before": "times > 0 AND length(prev) > 3 AND substr(edit, 1, length(prev)) = prev AND substr(edit, length(prev) + 1) = source",
    "copies the next": "times > 0 AND length(next) > 3 AND substr(edit, 1, length(source)) = source AND substr(edit, length(source) + 1) = next",
}
_REVIEWED = "SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in REVIEWED.items()) + " FROM (SELECT span_id, kind, source, ord + span_ord AS m, coalesce(lag(source) OVER w, '') AS prev, coalesce(lead(source) OVER w, '') AS next FROM v_spans WINDOW w AS (PARTITION BY unit_id ORDER BY span_ord))"


@query(broken(_REVIEWED, REVIEW_RULES, "span_id", *SPANS))
def review_answers(spark, sf_dir):
    """Answers of a review that break a rule: each span once, nothing edited that is correct, category and severity of an issue, no edit of
    code, of white space alone, or that takes in the span before or after."""
    w = Window.partitionBy("unit_id").orderBy("span_ord")
    s = V.spans(spark, sf_dir).select("span_id", "kind", "source", (F.col("ord") + F.col("span_ord")).alias("m"), F.coalesce(F.lag("source").over(w), F.lit("")).alias("prev"), F.coalesce(F.lead("source").over(w), F.lit("")).alias("next"))
    a = s.select("*", *[F.expr(e).alias(n) for n, e in REVIEWED.items()])
    return violations(a, {rule: F.expr(e) for rule, e in REVIEW_RULES.items()}, "span_id")
