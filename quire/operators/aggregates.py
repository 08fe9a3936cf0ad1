"""Aggregations over calls, findings, boxes, cells and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.plans.registry import query
from quire.sources import views as V
from quire.sources.views import CELLS, MARKED, SPANS, UNITS, sql


@query("SELECT quality, count(*) FILTER (WHERE toxic = 1) AS severe, count(*) FILTER (WHERE toxic = 0) AS mild, count(*) AS findings FROM labels GROUP BY 1")
def severity_counts(spark, sf_dir):
    return V.table(spark, sf_dir, "labels").groupBy("quality").agg(F.count_if(F.col("toxic") == 1).alias("severe"), F.count_if(F.col("toxic") == 0).alias("mild"), F.count(F.lit(1)).alias("findings"))


@query(sql("SELECT task, count(DISTINCT event_type) FILTER (WHERE status IN ('succeeded', 'partial')) AS completed, 5 AS total, arg_min(event_type, event_id) FILTER (WHERE status = 'processing') AS active FROM v_calls GROUP BY 1", "v_calls"))
def stage_progress(spark, sf_dir):
    """Completed stages of all, and the first that is under way."""
    done = F.count_distinct(F.when(F.col("status").isin("succeeded", "partial"), F.col("event_type")))
    active = F.min(F.when(F.col("status") == "processing", F.struct("event_id", "event_type")))["event_type"]
    return V.calls(spark, sf_dir).groupBy("task").agg(done.alias("completed"), F.lit(5).alias("total"), active.alias("active"))


@query(sql("SELECT task, operation, count(DISTINCT call_id) AS observed, count(DISTINCT call_id) FILTER (WHERE status IN ('succeeded', 'partial')) AS completed FROM v_calls GROUP BY 1, 2", "v_calls"))
def call_progress(spark, sf_dir):
    done = F.count_distinct(F.when(F.col("status").isin("succeeded", "partial"), F.col("call_id")))
    return V.calls(spark, sf_dir).groupBy("task", "operation").agg(F.count_distinct("call_id").alias("observed"), done.alias("completed"))


@query(sql("SELECT event_type, sum(attempts)::BIGINT AS attempts, count(*) FILTER (WHERE contains(status, 'fail')) AS failed FROM v_calls GROUP BY 1", "v_calls"))
def api_call_counts(spark, sf_dir):
    """Attempts and log lines by class."""
    return V.calls(spark, sf_dir).groupBy("event_type").agg(F.sum("attempts").alias("attempts"), F.count_if(F.col("status").contains("fail")).alias("failed"))


@query(sql("SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE page <= 3) AS done, sum(CASE WHEN page <= 3 THEN n END)::BIGINT AS units_done FROM (SELECT doc_id, page, count(*) AS n FROM v_units GROUP BY 1, 2) GROUP BY 1", *UNITS))
def pages_progress(spark, sf_dir):
    """Pages of the first completed parts."""
    pages = V.units(spark, sf_dir).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"))
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("page") <= 3).alias("done"), F.sum(F.when(F.col("page") <= 3, F.col("n"))).alias("units_done"))


@query(sql("SELECT c.task, count(*) AS active, count(*) FILTER (WHERE c.ts < s.started + INTERVAL 1 HOUR) AS reused FROM v_calls c JOIN (SELECT task, min(ts) AS started FROM v_calls GROUP BY 1) s USING (task) GROUP BY 1", "v_calls"))
def llm_progress(spark, sf_dir):
    """Calls in the index, and those from before the task's start."""
    c = V.calls(spark, sf_dir)
    started = c.groupBy("task").agg(F.min("ts").alias("started"))
    return c.join(started, "task").groupBy("task").agg(F.count(F.lit(1)).alias("active"), F.count_if(F.col("ts") < F.col("started") + F.expr("INTERVAL 1 HOUR")).alias("reused"))


@query(sql("SELECT source_key, logical_path, count(*) AS points, count(DISTINCT revision) AS revisions FROM v_points GROUP BY 1, 2", "v_points"))
def registration_totals(spark, sf_dir):
    return V.points(spark, sf_dir).groupBy("source_key", "logical_path").agg(F.count(F.lit(1)).alias("points"), F.count_distinct("revision").alias("revisions"))


@query(sql("SELECT l.lang AS role, k.kind, count(p.unit_id) AS pending FROM (SELECT DISTINCT lang FROM documents) l CROSS JOIN (SELECT unnest(['heading', 'list_item', 'paragraph', 'table']) AS kind) k LEFT JOIN (SELECT * FROM v_units WHERE unit_id NOT IN (SELECT unit_id FROM v_v2)) p ON p.lang = l.lang AND p.kind = k.kind GROUP BY 1, 2", *UNITS, "v_v2"))
def pending_counts(spark, sf_dir):
    """What is pending in each role, roles without any as zero."""
    roles = V.table(spark, sf_dir, "documents").select("lang").distinct().select("lang", F.explode(F.array(*map(F.lit, ("heading", "list_item", "paragraph", "table")))).alias("kind"))
    pending = V.units(spark, sf_dir).join(V.version2(spark, sf_dir), "unit_id", "left_anti").groupBy("lang", "kind").agg(F.count(F.lit(1)).alias("n"))
    return roles.join(pending, ["lang", "kind"], "left").select(F.col("lang").alias("role"), "kind", F.coalesce("n", F.lit(0)).alias("pending"))


@query(sql("SELECT page, quantile_cont(r - l, 0.5) * 0.6 AS tolerance FROM v_boxes GROUP BY 1", "v_boxes"))
def page_width_median(spark, sf_dir):
    """Six tenths of the median width of a page's items."""
    return V.boxes(spark, sf_dir).groupBy("page").agg((F.percentile(F.col("r") - F.col("l"), 0.5) * 0.6).alias("tolerance"))


def anchors_of(values: F.Column, tolerance: float) -> F.Column:
    """Sorted values in groups: a new anchor where a value is farther than tolerance from the last anchor."""
    none = F.array().cast("array<double>")
    return F.aggregate(F.array_sort(values), none, lambda a, x: F.when((F.size(a) == 0) | (x - F.element_at(F.concat(F.array(F.lit(-1e18)), a), -1) > tolerance), F.concat(a, F.array(x))).otherwise(a))


@query()
def column_anchors(spark, sf_dir):
    """Left edges of a page's columns, by an ordered fold."""
    return V.boxes(spark, sf_dir).groupBy("page").agg(anchors_of(F.collect_list(F.col("l").cast("double")), 6.0).alias("anchors"))


def bands(df: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """Unions of intervals: a new band begins where none of those before reaches; intervals without a start or an end come last, as in SQL."""
    w = Window.partitionBy(by).orderBy(F.asc_nulls_last(start), F.asc_nulls_last(end))
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("new", F.when(F.col(start) <= reach, 0).otherwise(1))
    return marked.withColumn("band", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))


@query(sql("SELECT page, band, min(t)::BIGINT AS top, max(b)::BIGINT AS bottom, count(*) AS items FROM (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY t, b ROWS UNBOUNDED PRECEDING)::BIGINT AS band FROM (SELECT *, CASE WHEN t <= max(b) OVER (PARTITION BY page ORDER BY t, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM v_boxes)) GROUP BY 1, 2", "v_boxes"))
def vertical_bands(spark, sf_dir):
    return bands(V.boxes(spark, sf_dir), "page", "t", "b").groupBy("page", "band").agg(F.min("t").alias("top"), F.max("b").alias("bottom"), F.count(F.lit(1)).alias("items"))


@query(sql("SELECT sha, count(*) AS n, min(lower(path)) AS first_path FROM v_files GROUP BY 1 HAVING count(*) > 1", "v_files"))
def duplicate_ids(spark, sf_dir):
    return V.files(spark, sf_dir).groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.min(F.lower("path")).alias("first_path")).where("n > 1")


@query(sql("SELECT doc_id, string_agg(word, ' ' ORDER BY first) AS words FROM (SELECT doc_id, word, min(k) AS first FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS k FROM (SELECT doc_id, string_agg(text, ' ' ORDER BY ord) AS text FROM v_units GROUP BY 1)) GROUP BY 1, 2) GROUP BY 1", *UNITS))
def ordered_distinct(spark, sf_dir):
    """Distinct words of a document in the order they first occur."""
    words = V.units(spark, sf_dir).select("doc_id", "ord", F.posexplode(F.split("text", " ")).alias("k", "word"))
    first = words.groupBy("doc_id", "word").agg(F.min(F.struct("ord", "k")).alias("at"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"])
    return first.groupBy("doc_id").agg(F.array_join(ordered, " ").alias("words"))


@query(sql("SELECT task, round, least(count(*), 5) AS kept, greatest(count(*) - 5, 0) AS dropped FROM v_calls WHERE operation = 'evaluate' GROUP BY 1, 2", "v_calls"))
def findings_rollup(spark, sf_dir):
    """Findings of a call up to its cap, and how many are over it."""
    w = Window.partitionBy("task", "round").orderBy("event_id")
    ranked = V.calls(spark, sf_dir).where("operation = 'evaluate'").withColumn("k", F.row_number().over(w))
    return ranked.groupBy("task", "round").agg(F.count_if(F.col("k") <= 5).alias("kept"), F.count_if(F.col("k") > 5).alias("dropped"))


@query(sql("SELECT call_id, count(DISTINCT tokens) AS texts FROM v_calls GROUP BY 1 HAVING count(DISTINCT tokens) > 1", "v_calls"))
def edit_conflicts(spark, sf_dir):
    """Spans that edits give more than one text."""
    return V.calls(spark, sf_dir).groupBy("call_id").agg(F.count_distinct("tokens").alias("texts")).where("texts > 1")


FAILS = "SELECT task, operation, count(*) AS failures FROM (SELECT *, coalesce(max(CASE WHEN status = 'succeeded' THEN event_id END) OVER (PARTITION BY task, operation), -1) AS last_ok FROM v_calls) WHERE status = 'failed' AND event_id > last_ok GROUP BY 1, 2"


@query(sql(f"SELECT task, operation, failures FROM ({FAILS}) WHERE failures >= 1", "v_calls"))
def exhausted_units(spark, sf_dir):
    """Failures since the last success."""
    c = V.calls(spark, sf_dir)
    last = c.where("status = 'succeeded'").groupBy("task", "operation").agg(F.max("event_id").alias("last_ok"))
    return c.where("status = 'failed'").join(last, ["task", "operation"], "left").where("event_id > coalesce(last_ok, -1)").groupBy("task", "operation").agg(F.count(F.lit(1)).alias("failures"))


@query(sql("SELECT f.task, count(DISTINCT f.round) AS rounds FROM v_calls f LEFT JOIN (SELECT task, max(round) AS last FROM v_calls WHERE status = 'succeeded' AND event_type = 'purchase' GROUP BY 1) s USING (task) WHERE f.status = 'failed' AND f.round >= coalesce(s.last, 0) GROUP BY 1", "v_calls"))
def match_failures(spark, sf_dir):
    """Distinct rounds that failed at or after the last success."""
    c = V.calls(spark, sf_dir)
    last = c.where("status = 'succeeded' AND event_type = 'purchase'").groupBy("task").agg(F.max("round").alias("last"))
    return c.where("status = 'failed'").join(last, "task", "left").where("round >= coalesce(last, 0)").groupBy("task").agg(F.count_distinct("round").alias("rounds"))


@query(sql("SELECT root, sha256(to_json(list([part, h] ORDER BY part))::VARCHAR) AS tree FROM (SELECT split_part(path, '/', 1) AS root, substr(sha256(path), 1, 3) AS part, sha256(to_json(list([path, sha] ORDER BY path))::VARCHAR) AS h FROM v_files GROUP BY 1, 2) GROUP BY 1", "v_files"))
def tree_hash(spark, sf_dir):
    """One hash of a folder, of canonical JSON: of 4,096 parts by the paths' own hashes, each the hash of its sorted paths and their hashes, so no task holds all paths."""
    f = V.files(spark, sf_dir).select(F.split_part("path", F.lit("/"), F.lit(1)).alias("root"), F.substring(F.sha2("path", 256), 1, 3).alias("part"), "path", "sha")
    listed = lambda a, b: F.sha2(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct(a, b))), lambda x: F.array(x[a], x[b]))), 256)
    return f.groupBy("root", "part").agg(listed("path", "sha").alias("h")).groupBy("root").agg(listed("part", "h").alias("tree"))


@query(sql("SELECT tab, max(row) + 1 AS n_rows, max(col) + 1 AS n_cols FROM v_cells GROUP BY 1", *CELLS))
def table_dims(spark, sf_dir):
    return V.cells(spark, sf_dir).groupBy("tab").agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"))


@query(sql("SELECT tab, count(*) FILTER (WHERE lead) AS header_rows FROM (SELECT tab, row, min(h::INT) OVER (PARTITION BY tab ORDER BY row) = 1 AS lead FROM (SELECT tab, row, bool_and(header OR tab % 3 = row) AS h FROM v_cells GROUP BY 1, 2)) GROUP BY 1", *CELLS))
def header_run(spark, sf_dir):
    """How many rows from the first on consist of header cells."""
    rows = V.cells(spark, sf_dir).groupBy("tab", "row").agg(F.bool_and(F.col("header") | (F.col("tab") % 3 == F.col("row"))).alias("h"))
    lead = F.min(F.col("h").cast("int")).over(Window.partitionBy("tab").orderBy("row")) == 1
    return rows.withColumn("lead", lead).groupBy("tab").agg(F.count_if("lead").alias("header_rows"))


@query(sql("SELECT lang, kind, count(*) AS spans, count(DISTINCT unit_id) AS units, round(count(*) / count(DISTINCT unit_id), 6) AS per_unit FROM (SELECT s.*, u.lang, u.kind AS k FROM v_spans s JOIN v_units u USING (unit_id)) GROUP BY lang, kind", *SPANS))
def unit_stats(spark, sf_dir):
    u = V.units(spark, sf_dir).select("unit_id", "lang")
    return V.spans(spark, sf_dir).join(u, "unit_id").groupBy("lang", "kind").agg(F.count(F.lit(1)).alias("spans"), F.count_distinct("unit_id").alias("units"), F.round(F.count(F.lit(1)) / F.count_distinct("unit_id"), 6).alias("per_unit"))


@query(sql("SELECT call_id, sum(attempts)::BIGINT AS attempts, max(attempts) AS most FROM v_calls GROUP BY 1", "v_calls"))
def attempt_totals(spark, sf_dir):
    return V.calls(spark, sf_dir).groupBy("call_id").agg(F.sum("attempts").alias("attempts"), F.max("attempts").alias("most"))


@query(sql("SELECT task, printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) AS duration FROM (SELECT task, date_diff('second', date_trunc('second', min(ts)), date_trunc('second', max(ts))) AS s FROM v_calls GROUP BY 1)", "v_calls"))
def run_duration(spark, sf_dir):
    s = F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))
    d = V.calls(spark, sf_dir).groupBy("task").agg(s.alias("s"))
    return d.select("task", F.format_string("%02d:%02d:%02d", F.floor(F.col("s") / 3600), F.floor(F.col("s") / 60) % 60, F.col("s") % 60).alias("duration"))


@query(sql("SELECT task, status, ts AS updated_at, event_id, CASE status WHEN 'succeeded' THEN 'done' WHEN 'failed' THEN 'failed' ELSE 'running' END || ' ' || task AS label, strftime(ts, '%Y-%m-%d %H:%M') AS date FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY ts DESC, event_id DESC) AS k FROM v_calls) WHERE k = 1 ORDER BY ts DESC, event_id DESC LIMIT 100", "v_calls"))
def run_history(spark, sf_dir):
    """The hundred runs updated last, with what a list shows of them."""
    last = V.calls(spark, sf_dir).groupBy("task").agg(F.max(F.struct("ts", "event_id", "status")).alias("m"))
    state = F.when(F.col("m.status") == "succeeded", "done").when(F.col("m.status") == "failed", "failed").otherwise("running")
    shown = last.select("task", "m.status", F.col("m.ts").alias("updated_at"), "m.event_id", F.concat_ws(" ", state, "task").alias("label"), F.date_format("m.ts", "yyyy-MM-dd HH:mm").alias("date"))
    return shown.orderBy(F.desc("updated_at"), F.desc("event_id")).limit(100)


#: Files of one registration or upload at most.
MOST_FILES = 100
LISTED = "SELECT *, split_part(path, '/', 1) || '/' || (doc_id // 8) || '.pdf' AS logical, doc_id % 29 = 0 AS symlink, doc_id % 31 = 0 AS own_output FROM v_files"


@query(sql(f"SELECT path, size, sha, logical, duplicate, n > {MOST_FILES} AS too_many FROM (SELECT *, split_part(path, '/', 1) AS root, count(*) OVER (PARTITION BY logical) > 1 AS duplicate FROM ({LISTED}) WHERE lower(path) LIKE '%.pdf' AND NOT symlink AND NOT own_output) JOIN (SELECT split_part(path, '/', 1) AS root, count(*) AS n FROM ({LISTED}) WHERE lower(path) LIKE '%.pdf' AND NOT symlink AND NOT own_output GROUP BY 1) USING (root)", "v_files"))
def source_listing(spark, sf_dir):
    """Accepted files of a listing (no links, nothing of the output's folder), whether two share a logical path, and whether their folder has too many."""
    root = F.split_part("path", F.lit("/"), F.lit(1))
    f = V.files(spark, sf_dir).withColumn("root", root).withColumn("logical", F.concat(root, F.lit("/"), F.floor(F.col("doc_id") / 8), F.lit(".pdf")))
    kept = f.where(F.lower("path").endswith(".pdf")).where("doc_id % 29 <> 0 AND doc_id % 31 <> 0")
    sizes = kept.groupBy("root").agg((F.count(F.lit(1)) > MOST_FILES).alias("too_many"))
    return kept.join(sizes, "root").select("path", "size", "sha", "logical", (F.count(F.lit(1)).over(Window.partitionBy("logical")) > 1).alias("duplicate"), "too_many")


@query(sql(f"SELECT root, sum(n)::BIGINT AS files, sum(n) > {MOST_FILES} AS too_many, bool_or(n > 1) AS duplicate, bool_or(folder) AND bool_or(file) AS mixed FROM (SELECT split_part(path, '/', 1) AS root, lower(split_part(path, '/', 2)) AS name, count(*) AS n, bool_or(doc_id % 40 = 0) AS folder, bool_or(doc_id % 40 <> 0) AS file FROM v_files GROUP BY 1, 2) GROUP BY 1", "v_files"))
def upload_sets(spark, sf_dir):
    """Uploads of a source: too many files, names that differ in case only, folders (here every fortieth) among files."""
    p, d = F.split("path", "/"), F.col("doc_id") % 40 == 0
    names = V.files(spark, sf_dir).groupBy(p[0].alias("root"), F.lower(p[1]).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(d).alias("folder"), F.bool_or(~d).alias("file"))
    return names.groupBy("root").agg(F.sum("n").alias("files"), (F.sum("n") > MOST_FILES).alias("too_many"), F.bool_or(F.col("n") > 1).alias("duplicate"), (F.bool_or("folder") & F.bool_or("file")).alias("mixed"))


@query(sql("SELECT doc_id, marker, count(*) AS n, count(*) = 1 AS only FROM (SELECT doc_id, unnest(regexp_extract_all(raw, '\\(([0-9]+)\\)', 1)) AS marker FROM v_marked) GROUP BY 1, 2", *MARKED))
def marker_counts(spark, sf_dir):
    """How often each marker in brackets stands in a document, and whether it is the only one."""
    m = V.marked(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("raw", F.lit(r"\(([0-9]+)\)"), F.lit(1))).alias("marker"))
    return m.groupBy("doc_id", "marker").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) == 1).alias("only"))


#: Ids that the schema of a request may list.
MOST_IDS = 32


@query(sql(f"SELECT task, operation, n AS ids, least(n, {MOST_IDS}) AS max_items, n > {MOST_IDS} AS split_needed, (n + {MOST_IDS - 1}) // {MOST_IDS} AS requests FROM (SELECT task, operation, count(DISTINCT event_id) AS n FROM v_calls GROUP BY 1, 2)", "v_calls"))
def request_ids(spark, sf_dir):
    """How many ids a request of a task may answer with: all that it asks for, up to the cap of a schema; more need several requests."""
    n = F.count_distinct("event_id")
    g = V.calls(spark, sf_dir).groupBy("task", "operation").agg(n.alias("ids"))
    return g.select("task", "operation", "ids", F.least("ids", F.lit(MOST_IDS)).alias("max_items"), (F.col("ids") > MOST_IDS).alias("split_needed"), F.ceil(F.col("ids") / MOST_IDS).alias("requests"))


@query(sql("SELECT split_part(path, '/', 1) AS root, split_part(path, '/', 2) AS name, sha, size FROM v_files", "v_files"))
def artifact_manifest(spark, sf_dir):
    p = F.split("path", "/")
    return V.files(spark, sf_dir).select(p[0].alias("root"), p[1].alias("name"), "sha", "size")


@query(sql("SELECT doc_id, part, (part - 1) * 3 + 1 AS page_start, least(part * 3, n) AS page_end FROM (SELECT doc_id, max(page)::BIGINT AS n, unnest(range(1, (max(page) + 2) // 3 + 1)) AS part FROM v_units GROUP BY 1)", *UNITS))
def page_range_split(spark, sf_dir):
    """Ranges of at most three pages."""
    n = V.units(spark, sf_dir).groupBy("doc_id").agg(F.max("page").cast("long").alias("n"))
    parts = n.select("doc_id", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.floor((F.col("n") + 2) / 3))).alias("part"))
    return parts.select("doc_id", "part", ((F.col("part") - 1) * 3 + 1).alias("page_start"), F.least(F.col("part") * 3, F.col("n")).alias("page_end"))


@query(sql("SELECT lower(split_part(path, '/', 2)) AS name, count(*) AS n, bool_or(NOT regexp_matches(path, '^[A-Za-z0-9/._-]+$')) AS unsafe, count(*) > 1 AS duplicate FROM v_files GROUP BY 1", "v_files"))
def upload_name_checks(spark, sf_dir):
    f = V.files(spark, sf_dir)
    return f.groupBy(F.lower(F.split("path", "/")[1]).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(~F.col("path").rlike("^[A-Za-z0-9/._-]+$")).alias("unsafe"), (F.count(F.lit(1)) > 1).alias("duplicate"))


@query(sql("SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page, cell, ord) AS text FROM (SELECT doc_id, page, ord % 4 = 3 AS cell, text, min(ord) AS ord FROM v_units GROUP BY 1, 2, 3, 4, CASE WHEN ord % 4 = 3 THEN 0 ELSE ord END) GROUP BY 1", *UNITS))
def extracted_text(spark, sf_dir):
    """Texts of parts (pages) put together in their order: in each its texts, then every different cell once."""
    cell = F.col("ord") % 4 == 3
    once = V.units(spark, sf_dir).groupBy("doc_id", "page", cell.alias("cell"), "text", F.when(cell, 0).otherwise(F.col("ord")).alias("own")).agg(F.min("ord").alias("ord"))
    parts = F.sort_array(F.collect_list(F.struct("page", "cell", "ord", "text")))
    return once.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("text"))


@query("SELECT lower(trim(split_part(text, ' ', 1))) AS term, min(item_id) AS item_id, count(*) AS n FROM benchmark GROUP BY 1")
def glossary_terms(spark, sf_dir):
    return V.table(spark, sf_dir, "benchmark").groupBy(F.lower(F.trim(F.split("text", " ")[0])).alias("term")).agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("n"))
