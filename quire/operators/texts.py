"""Rules on texts (quire.functions.rules) over units, cells and calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import rules as R
from quire.functions.json_refs import refs_of
from quire.functions.text import by_row
from quire.plans.registry import query
from quire.sources import views as V
from quire.sources.views import CELLS, MARKED, UNITS, sql

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def gsub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def got(x: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({x}, '{pattern}', {group})"


def on_marked(select: str) -> str:
    return sql(f"SELECT unit_id, {select} FROM v_marked", *MARKED)


def marked(spark, sf_dir, **columns) -> DataFrame:
    return V.marked(spark, sf_dir).select("unit_id", *[c.alias(name) for name, c in columns.items()])


def raw():
    return F.col("raw")


def num():
    return F.col("k")


@query(on_marked(STRIP.format(gsub(gsub(gsub(gsub("raw", R.CONTROL), r"\.{3,}", "..."), "・{3,}", "・・・"), r"[ \t]+", " ")) + " AS text"))
def clean_text(spark, sf_dir):
    return marked(spark, sf_dir, text=R.cleaned(raw()))


def _row_label_sql(x: str) -> str:
    return gsub(gsub(f"lower({x})", r"\s*([_-])\s*", r"\1"), r"\s+(\d)", r"\1")


@query(on_marked(f"{_row_label_sql('raw')} AS label"))
def row_label_key(spark, sf_dir):
    return marked(spark, sf_dir, label=R.row_label(raw()))


WRAP_SQL = """SELECT l_orderkey AS tab, l_linenumber AS line, l_partkey AS part, CASE l_partkey % 5 WHEN 0 THEN (l_suppkey % 99 + 1) || ',' || lpad((l_partkey % 100)::VARCHAR, 2, '0') || ' ' || l_suppkey % 10 WHEN 1 THEN (l_suppkey % 9 + 1) || ',' || (l_partkey % 10) || chr(10) || lpad((l_suppkey % 100)::VARCHAR, 2, '0')
WHEN 2 THEN l_suppkey % 100 || ' ' || l_partkey % 100 WHEN 3 THEN 'iv-' || l_suppkey % 9 || ' ' || l_partkey % 10 ELSE l_suppkey % 50 || ',' || lpad((l_partkey % 1000)::VARCHAR, 3, '0') || ' ' || l_partkey % 1000 END AS text FROM lineitem"""


def wrapped(spark, sf_dir) -> DataFrame:
    """(tab, line, part, text): numbers of order lines as a table's cells, some cut by a space or a line end."""
    s, p = F.col("l_suppkey"), F.col("l_partkey")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    text = (
        F.when(p % 5 == 0, F.concat(s % 99 + 1, F.lit(","), pad(p % 100, 2), F.lit(" "), s % 10)).when(p % 5 == 1, F.concat(s % 9 + 1, F.lit(","), p % 10, F.lit("\n"), pad(s % 100, 2)))
        .when(p % 5 == 2, F.concat(s % 100, F.lit(" "), p % 100)).when(p % 5 == 3, F.concat(F.lit("iv-"), s % 9, F.lit(" "), p % 10)).otherwise(F.concat(s % 50, F.lit(","), pad(p % 1000, 3), F.lit(" "), p % 1000))
    )
    return V.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tab"), F.col("l_linenumber").alias("line"), p.alias("part"), text.alias("text"))


_N, _T = got("text", R.WRAPPED), got("text", R.WRAPPED, 2)
VALUE_SQL = f"CASE WHEN contains({_N}, ',') AND length(list_last(string_split({_N}, ','))) + length({_T}) = 3 THEN {_N} || {_T} ELSE text END"


@query(f"WITH w AS ({WRAP_SQL}) SELECT tab, line, part, {VALUE_SQL} AS value FROM w")
def table_values(spark, sf_dir):
    return wrapped(spark, sf_dir).select("tab", "line", "part", R.table_value(F.col("text")).alias("value"))


@query(f"WITH w AS ({WRAP_SQL}), v AS (SELECT tab, line, part, {VALUE_SQL} AS t FROM w) SELECT tab, line, part, array_to_string(regexp_extract_all(CASE WHEN {has('t', R.PAGE_WORD)} THEN {gsub('t', chr(40) + '[0-9]' + chr(41) + chr(92) + 's+', chr(92) + '1')} ELSE t END, '{R.NUMBER}'), ' ') AS numbers FROM v")
def row_numbers(spark, sf_dir):
    return wrapped(spark, sf_dir).select("tab", "line", "part", F.array_join(R.numbers_of(F.col("text")), " ").alias("numbers"))


@query(sql(f"SELECT tab, row, col, nullif({got(chr(39) + 't-r' + chr(39) + ' || row || ' + chr(39) + '-c' + chr(39) + ' || col || CASE WHEN col < 4 THEN ' + chr(39) + '/content' + chr(39) + ' ELSE ' + chr(39) + '/image' + chr(39) + ' END', R.CELL_ID)}, '') AS column_id FROM v_cells", *CELLS))
def cell_columns(spark, sf_dir):
    unit = F.concat(F.lit("t-r"), F.col("row"), F.lit("-c"), F.col("col"), F.when(F.col("col") < 4, "/content").otherwise("/image"))
    return V.cells(spark, sf_dir).select("tab", "row", "col", R.cell_column(unit).alias("column_id"))


LEFT_SQL = "CASE WHEN k % 6 = 0 THEN 'Abstract' ELSE (k % 4 + 1) || '.' || k % 7 END"
RIGHT_SQL = "CASE WHEN k % 5 = 0 THEN 'Summary' ELSE (k % 3 + 1) || '.' || k % 5 || '.' || k % 2 END"


def left():
    return F.when(num() % 6 == 0, "Abstract").otherwise(F.concat(num() % 4 + 1, F.lit("."), num() % 7))


def right():
    return F.when(num() % 5 == 0, "Summary").otherwise(F.concat(num() % 3 + 1, F.lit("."), num() % 5, F.lit("."), num() % 2))


PARTS_SQL = "list_transform(string_split({}, '.'), lambda x: try_cast(x AS BIGINT))"
DISTANCE_SQL = f"""SELECT unit_id, l, r, CASE WHEN {has('l', R.NUMBER_HEAD)} AND {has('r', R.NUMBER_HEAD)} THEN list_sum(list_transform(generate_series(1, greatest(len(a), len(b))), lambda i: abs(coalesce(a[i], 0) - coalesce(b[i], 0))))::BIGINT END AS distance
FROM (SELECT *, {PARTS_SQL.format(got('l', R.NUMBER_HEAD))} AS a, {PARTS_SQL.format(got('r', R.NUMBER_HEAD))} AS b FROM (SELECT unit_id, {LEFT_SQL} AS l, {RIGHT_SQL} AS r FROM v_marked))"""


@query(sql(f"SELECT unit_id, distance, CASE WHEN distance IS NOT NULL THEN least(0.3::DOUBLE, 0.05::DOUBLE * distance) WHEN {has('l', R.NUMBER_HEAD)} AND NOT {has('r', R.NUMBER_HEAD)} THEN 0.3::DOUBLE ELSE 0::DOUBLE END AS penalty FROM ({DISTANCE_SQL})", *MARKED))
def section_penalties(spark, sf_dir):
    return marked(spark, sf_dir, distance=R.section_distance(left(), right()), penalty=R.section_penalty(left(), right()))


@query(on_marked("CASE WHEN k % 9 = 0 THEN 0::DOUBLE ELSE round(least(3::DOUBLE, 3::DOUBLE * abs(k % 8 / 8.0::DOUBLE - k % 5 / 5.0::DOUBLE)), 9) END AS penalty"))
def position_penalties(spark, sf_dir):
    place = F.when(num() % 9 == 0, "unknown").otherwise((num() % 8 / F.lit(8.0)).cast("string"))
    return marked(spark, sf_dir, penalty=F.round(R.position_penalty(place, (num() % 5 / F.lit(5.0)).cast("string")), 9))


@query(on_marked(", ".join(f"{gsub('raw', p)} AS {n}" for n, p in (("heading_text", R.HEADING_TEXT), ("heading_out", R.HEADING_OUT), ("caption_out", R.CAPTION_OUT), ("footnote_out", R.FOOTNOTE_OUT)))))
def number_strips(spark, sf_dir):
    """Leading numbers taken off headings (for search, for output), captions and footnotes."""
    return marked(spark, sf_dir, **{n: F.regexp_replace(raw(), p, "") for n, p in (("heading_text", R.HEADING_TEXT), ("heading_out", R.HEADING_OUT), ("caption_out", R.CAPTION_OUT), ("footnote_out", R.FOOTNOTE_OUT))})


_D = got("raw", R.NUMBERED)


@query(on_marked(f"CASE WHEN {has('raw', R.NUMBERED)} THEN (length({_D}) - length(replace({_D}, '.', '')) + 1)::INT END AS depth, {has('raw', R.TOP_LEVEL)} AS top_level"))
def heading_marks(spark, sf_dir):
    return marked(spark, sf_dir, depth=R.heading_depth(raw()).cast("int"), top_level=raw().rlike(R.TOP_LEVEL))


@query(on_marked(f"{has('raw', R.INDEX_TITLE)} AS title, {has('raw', R.INDEX_ENTRY)} AS entry"))
def index_lines(spark, sf_dir):
    """Titles of tables of contents, and their lines: a leader and a page."""
    return marked(spark, sf_dir, title=raw().rlike(R.INDEX_TITLE), entry=raw().rlike(R.INDEX_ENTRY))


@query(on_marked(r"array_to_string(list_sort(list_distinct(regexp_extract_all(raw, '(?:^|\D)\(\s*(\d+)\s*\)', 1))), ',') AS items"))
def list_item_numbers(spark, sf_dir):
    return marked(spark, sf_dir, items=F.array_join(R.list_items(raw()), ","))


@query(on_marked(STRIP.format(gsub(gsub(gsub("raw", r"[\s\x{3000}]+", " "), f"({R.CJK})\\s+", r"\1"), f"\\s+({R.CJK})", r"\1")) + " AS text"))
def without_cjk_spaces(spark, sf_dir):
    return marked(spark, sf_dir, text=R.without_extraction_spaces(raw()))


_V = gsub("raw", r"\s+")


@query(on_marked(f"CASE WHEN {has(_V, R.DATE)} THEN try_cast({gsub(_V, R.DATE, chr(92) + '1-' + chr(92) + '2-' + chr(92) + '3')} AS DATE)::VARCHAR END AS day"))
def date_values(spark, sf_dir):
    return marked(spark, sf_dir, day=R.date_value(raw()).cast("string"))


@query(on_marked(f"CASE WHEN {has('raw', R.PAGE_REF)} THEN {gsub('raw', R.PAGE_REF, chr(92) + '1 ' + chr(92) + '2')} END AS ref"))
def page_refs(spark, sf_dir):
    return marked(spark, sf_dir, ref=R.page_ref(raw()))


@query(on_marked(f"trim({gsub('raw', '[.]{2,}')}) AS text, {gsub('raw', R.LEADERS)} AS cell"))
def dot_leaders(spark, sf_dir):
    return marked(spark, sf_dir, text=F.trim(F.regexp_replace(raw(), "[.]{2,}", "")), cell=F.regexp_replace(raw(), R.LEADERS, ""))


@query(on_marked(f"{gsub('raw', R.SIGNS, chr(92) * 3 + '1')} AS escaped, replace(replace(replace(raw, ' ', '%20'), '(', '%28'), ')', '%29') AS url, coalesce(nullif({gsub(gsub('raw', '[^A-Za-z0-9_-]+', '-'), '^-+|-+$')}, ''), 'item') AS anchor"))
def markdown_escapes(spark, sf_dir):
    return marked(spark, sf_dir, escaped=R.markdown_escaped(raw()), url=R.url_escaped(raw()), anchor=R.anchor(raw()))


@query(on_marked("repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(raw, '`+'), lambda x: length(x))), 0) + 1)) AS fence"))
def code_fences(spark, sf_dir):
    return marked(spark, sf_dir, fence=R.fence(raw()))


@query(on_marked(r"trim(regexp_replace(lower(raw), '\s+', ' ', 'g')) AS folded"))
def folded_text(spark, sf_dir):
    return marked(spark, sf_dir, folded=R.folded(raw()))


QUOTE_SQL = "CASE WHEN regexp_matches({0}, '[\",\\n\\r]') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE {0} END"


@query(on_marked(f"k || ',' || {QUOTE_SQL.format('raw')} || chr(10) AS line"))
def csv_lines(spark, sf_dir):
    return marked(spark, sf_dir, line=R.csv_row(num(), raw()))


@query(on_marked(r"regexp_matches(raw, '[\p{L}\p{N}]') AS alnum, length(regexp_replace(raw, '[^\x{3040}-\x{30ff}\x{4e00}-\x{9fff}]', '', 'g')) AS japanese, length(raw) AS signs"))
def character_classes(spark, sf_dir):
    """Whether a text has a letter or digit, and how many Japanese signs."""
    return marked(spark, sf_dir, alnum=raw().rlike(r"[\p{L}\p{N}]"), japanese=F.length(F.regexp_replace(raw(), r"[^\x{3040}-\x{30ff}\x{4e00}-\x{9fff}]", "")).cast("long"), signs=F.length(raw()).cast("long"))


TARGET_SQL = "CASE k % 4 WHEN 0 THEN 'http://h/' || k WHEN 1 THEN 'a%20b/' || k || '.png?q=1' WHEN 2 THEN '../up/' || k ELSE '//host/' || k END"


def target():
    return F.when(num() % 4 == 0, F.concat(F.lit("http://h/"), num())).when(num() % 4 == 1, F.concat(F.lit("a%20b/"), num(), F.lit(".png?q=1"))).when(num() % 4 == 2, F.concat(F.lit("../up/"), num())).otherwise(F.concat(F.lit("//host/"), num()))


@query(sql(f"SELECT unit_id, CASE WHEN NOT {has('t', '^[A-Za-z][A-Za-z0-9+.-]*:|^//')} AND NOT {has('p', '(^|/)[.][.](/|$)|^/')} THEN p END AS path FROM (SELECT unit_id, t, url_decode(regexp_extract(t, '^([^?#]*)', 1)) AS p FROM (SELECT unit_id, {TARGET_SQL} AS t FROM v_marked))", *MARKED))
def local_paths(spark, sf_dir):
    return marked(spark, sf_dir, path=R.local_path(target()))


_S = STRIP.format("raw")


@query(sql(f"SELECT unit_id, CASE WHEN strlen(v) <= 400 THEN v END AS content, strlen(v) > 400 AS too_large FROM (SELECT unit_id, CASE WHEN starts_with({_S}, '```json') AND ends_with({_S}, '```') THEN {STRIP.format(f'substr({_S}, 8, length({_S}) - 10)')} ELSE {_S} END AS v FROM v_marked)", *MARKED))
def response_content(spark, sf_dir):
    """An answer without its JSON fence; null and marked where it is larger than allowed."""
    v = R.unfenced(raw())
    return marked(spark, sf_dir, content=R.within_bytes(v, 400), too_large=F.octet_length(v) > 400)


STATUS_SQL = "CASE event_id % 8 WHEN 0 THEN 200 WHEN 1 THEN 400 WHEN 2 THEN 401 WHEN 3 THEN 408 WHEN 4 THEN 413 WHEN 5 THEN 429 WHEN 6 THEN 503 ELSE 404 END"
MESSAGES = ("Maximum context exceeded", "json_schema is not supported", "Model x does not exist", "Too many tokens", "no cause", "Bad sequence length")
MESSAGE_SQL = "CASE event_id % 6 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MESSAGES)) + " END"


def _any_sql(marks) -> str:
    return "(" + " OR ".join(f"contains(lower(m), '{x}')" for x in marks) + ")"


@query(f"""SELECT event_id, s = 413 OR (s = 400 AND {_any_sql(R.OVERFLOW)}) AS overflow, CASE WHEN s = 408 THEN 'timeout' WHEN s IN (401, 403) THEN 'authentication' WHEN s = 429 THEN 'rate_limit' WHEN s >= 500 THEN 'provider' WHEN s >= 400 THEN 'rejected' END AS class,
CASE WHEN {_any_sql(R.CATEGORIES[0][1])} THEN 'structured_output' WHEN {_any_sql(R.CATEGORIES[1][1])} THEN 'input_limit' WHEN contains(lower(m), 'model') AND {_any_sql(R.UNKNOWN_MODEL)} THEN 'model' END AS category FROM (SELECT event_id, {STATUS_SQL} AS s, {MESSAGE_SQL} AS m FROM events)""")  # fmt: skip
def service_errors(spark, sf_dir):
    """Answers of a service by class and cause, without their text."""
    e = F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, (200, 400, 401, 408, 413, 429, 503, 404))), (e % 8 + 1).cast("int"))
    message = F.element_at(F.array(*map(F.lit, MESSAGES)), (e % 6 + 1).cast("int"))
    rows = V.table(spark, sf_dir, "events").select("event_id", status.alias("s"), message.alias("m"))
    return rows.select("event_id", R.is_overflow(F.col("s"), F.col("m")).alias("overflow"), R.error_class(F.col("s")).alias("class"), R.error_category(F.col("m")).alias("category"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id WHEN 3 THEN NULL ELSE NULL END AS tokens FROM events")
def usage_tokens(spark, sf_dir):
    """Reported numbers of tokens: negative ones, fractions and words are null."""
    e = F.col("event_id")
    said = F.when(e % 4 == 0, e.cast("string")).when(e % 4 == 1, F.concat(F.lit("-"), e + 1)).when(e % 4 == 2, F.concat(e, F.lit(".5"))).otherwise("many")
    return V.table(spark, sf_dir, "events").select("event_id", R.token_count(said).alias("tokens"))


PIECES = r"regexp_extract_all(raw, '{0}', {1})"


@query(sql(f"SELECT unit_id, i::INT AS nth, c[i] AS caption, t[i] AS target FROM (SELECT unit_id, c, t, unnest(generate_series(1, len(t))) AS i FROM (SELECT unit_id, {PIECES.format(R.IMAGE, 1)} AS c, {PIECES.format(R.IMAGE, 2)} AS t FROM v_marked))", *MARKED))
def image_links(spark, sf_dir):
    """Images of a text with their caption and target, in order."""
    s = V.marked(spark, sf_dir).select("unit_id", F.posexplode(R.image_segments(raw())).alias("pos", "s")).where("s.target IS NOT NULL")
    return s.select("unit_id", (F.col("pos") + 1).alias("nth"), "s.caption", "s.target")


@query()
def canonical_hashes(spark, sf_dir):
    """The hash of a record as canonical JSON, and its bytes with default separators; control signs are escaped."""
    fields = {"unit_id": F.col("unit_id"), "ord": F.col("ord"), "raw": raw()}
    return V.marked(spark, sf_dir).select("unit_id", F.sha2(R.canonical_json(**fields), 256).alias("sha"), R.json_size(**fields).cast("long").alias("bytes"))


@query(sql("SELECT child, CASE WHEN parent IS NULL THEN '' ELSE '#/nodes/' || parent END || CASE WHEN child % 2 = 0 THEN CASE WHEN parent IS NULL THEN '' ELSE ',' END || '#/pictures/' || child ELSE '' END AS refs FROM v_edges", "v_edges"))
def collected_refs(spark, sf_dir):
    """All references below a node, as its JSON holds them at any depth; its text, which quotes one, doesn't count."""
    ref = lambda *parts: F.struct(F.concat(*parts).alias("$ref"))
    node = F.struct(
        F.when(F.col("parent").isNotNull(), ref(F.lit("#/nodes/"), F.col("parent"))).alias("parent"),
        F.struct(F.when(F.col("child") % 2 == 0, F.array(ref(F.lit("#/pictures/"), F.col("child")))).alias("children")).alias("data"),
        F.lit('text with "$ref":"#/none"').alias("text"),
    )
    return V.edges(spark, sf_dir).select("child", F.array_join(by_row(refs_of, "array<string>")(F.to_json(node, {"pretty": "true"})), ",").alias("refs"))


# ---- small set and state operators ---------------------------------------------------------------


@query(sql("SELECT task, max(round) + 1 AS next_round, count(DISTINCT round) AS rounds FROM v_calls GROUP BY 1", "v_calls"))
def next_round(spark, sf_dir):
    return V.calls(spark, sf_dir).groupBy("task").agg((F.max("round") + 1).alias("next_round"), F.count_distinct("round").alias("rounds"))


@query(sql("SELECT unit_id, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM (SELECT unit_id, 'index' AS reason FROM v_units WHERE ord % 4 = 0 UNION ALL SELECT unit_id, 'header' FROM v_units WHERE ord = 1 UNION ALL SELECT unit_id, 'index' FROM v_units WHERE kind = 'list_item') GROUP BY 1", *UNITS))
def removal_union(spark, sf_dir):
    """Why a unit goes: reasons of all rules, each once."""
    found = F.array_distinct(F.filter(F.array(F.when(F.col("ord") % 4 == 0, "index"), F.when(F.col("ord") == 1, "header"), F.when(F.col("kind") == "list_item", "index")), lambda x: x.isNotNull()))
    return V.units(spark, sf_dir).select("unit_id", found.alias("r")).where(F.size("r") > 0).select("unit_id", F.array_join(F.array_sort("r"), ",").alias("reasons"))


@query(sql("SELECT a.unit_id, 'old' AS side FROM v_units a WHERE NOT EXISTS (SELECT 1 FROM v_v2 b WHERE b.unit_id = a.unit_id AND b.text = a.text) UNION ALL SELECT b.unit_id, 'new' FROM v_v2 b WHERE NOT EXISTS (SELECT 1 FROM v_units a WHERE b.unit_id = a.unit_id AND b.text = a.text)", *UNITS, "v_v2"))
def remaining_changes(spark, sf_dir):
    """What is left of both versions when identical units are taken out."""
    a, b = V.units(spark, sf_dir).select("unit_id", "text"), V.version2(spark, sf_dir).select("unit_id", "text")
    old = a.join(b, ["unit_id", "text"], "left_anti").select("unit_id", F.lit("old").alias("side"))
    return old.unionByName(b.join(a, ["unit_id", "text"], "left_anti").select("unit_id", F.lit("new").alias("side")))


@query(sql("SELECT unit_id, side, fails, CASE WHEN fails >= 3 THEN 'unverified' ELSE 'pending' END AS state FROM (SELECT unit_id, CASE WHEN ord % 2 = 0 THEN 'source' ELSE 'translation' END AS side, (doc_id * 31 + ord) % 5 AS fails FROM v_units WHERE ord % 3 <> 0)", *UNITS))
def unverified_groups(spark, sf_dir):
    """One-sided groups: three failed searches leave a unit unverified, fewer leave it pending."""
    fails = (F.col("doc_id") * 31 + F.col("ord")) % 5
    return V.units(spark, sf_dir).where("ord % 3 <> 0").select("unit_id", F.when(F.col("ord") % 2 == 0, "source").otherwise("translation").alias("side"), fails.alias("fails"), F.when(fails >= 3, "unverified").otherwise("pending").alias("state"))


@query(sql("SELECT doc_id, string_agg(ord::VARCHAR, ',' ORDER BY ord) AS shown FROM (SELECT doc_id, ord FROM v_units WHERE ord % 2 = 0 INTERSECT SELECT doc_id, ord FROM v_v2 WHERE ord % 3 = 0) GROUP BY 1", *UNITS, "v_v2"))
def requested_changes(spark, sf_dir):
    """Ids of a document that are both asked for and changed."""
    ask = V.units(spark, sf_dir).where("ord % 2 = 0").groupBy("doc_id").agg(F.collect_set("ord").alias("a"))
    have = V.version2(spark, sf_dir).where("ord % 3 = 0").groupBy("doc_id").agg(F.collect_set("ord").alias("b"))
    both = ask.join(have, "doc_id").where(F.arrays_overlap("a", "b")).select("doc_id", F.array_sort(F.array_intersect("a", "b")).alias("x"))
    return both.select("doc_id", F.array_join(F.transform("x", lambda v: v.cast("string")), ",").alias("shown"))


@query(sql("SELECT id AS image, min(owner) AS owner, count(DISTINCT owner) AS owners, count(DISTINCT owner) = 1 AS valid FROM (SELECT id, page || '/' || l // 200 AS owner FROM v_boxes WHERE label = 'image' UNION ALL SELECT id, page || '/' || (l // 200 + 1) FROM v_boxes WHERE label = 'image' AND id % 7 = 0) GROUP BY 1", "v_boxes"))
def explicit_owner(spark, sf_dir):
    """Images that cells name: exactly one owner is valid, several are a conflict."""
    b = V.boxes(spark, sf_dir).where("label = 'image'")
    column = F.floor(F.col("l") / 200)
    owners = F.concat(F.array(column), F.when(F.col("id") % 7 == 0, F.array(column + 1)).otherwise(F.array().cast("array<bigint>")))
    named = b.select(F.col("id").alias("image"), F.explode(F.transform(owners, lambda c: F.concat_ws("/", F.col("page"), c))).alias("owner"))
    n = F.count_distinct("owner")
    return named.groupBy("image").agg(F.min("owner").alias("owner"), n.alias("owners"), (n == 1).alias("valid"))


@query(sql("SELECT doc_id, lane, k FROM (SELECT doc_id, lane, row_number() OVER (PARTITION BY doc_id ORDER BY ord, lane) AS k FROM v_units, (SELECT unnest([0, 1, 2, 3, 4]) AS lane) WHERE (lane = 0 AND ord % 5 <> 4) OR (lane = 1 AND ord % 4 = 0) OR (lane = 2 AND ord % 7 = 0) OR (lane = 3 AND ord % 5 = 4) OR (lane = 4 AND ord % 10 = 4))", *UNITS))
def flatten_lanes(spark, sf_dir):
    """Units of a document in reading order, five lanes a block: content, caption, image caption, cells, captions of their images."""
    o = F.col("ord")
    lanes = F.filter(F.array(F.when(o % 5 != 4, 0), F.when(o % 4 == 0, 1), F.when(o % 7 == 0, 2), F.when(o % 5 == 4, 3), F.when(o % 10 == 4, 4)), lambda x: x.isNotNull())
    u = V.units(spark, sf_dir).select("doc_id", "ord", F.explode(lanes).alias("lane"))
    return u.select("doc_id", "lane", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "lane")).alias("k"))
