"""URL filters by rules and a path-template tree (operator 8).

Rules (host, path) come first; the longest that fits decides. For other urls, each host gets a tree
of path templates, as deep as its paths: numbers and hexadecimal segments become wildcards by form; children whose labelled share of
bad pages doesn't differ from their parent's by a two-proportion test (unlabelled ones never do) merge into one wildcard branch, at any
width, depth and length. A template is rejected if its share of bad labels, smoothed towards its host's and that towards all pages', is
over a threshold (half: so without labels none is). DataFrame functions only; trees are made from counts by host and path form, never from
rows. A round takes each branch to its next fork at once, so rounds are as many as forks lie on one path, whatever its length.

Cases: a null url, or one without ://, has empty host and path; null labels don't count; a page
with several labels is bad if one is; an empty table gives an empty one; repeated rows are judged
alike; a very long path is read whole; other columns of pages are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, fresh, table, written

#: (host, path, verdict): the production rules.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
Z2, STRENGTH, REJECT = 3.84, 5.0, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.regexp_extract(url, URL, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. rules: a bounded list."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def shape(path: Column) -> Column:
    """The path's segments, hexadecimal ones and numbers generalised."""
    form = lambda s: F.when(s.rlike("^[0-9a-fA-F]{8,}$") & s.rlike("[0-9]"), "{h}").otherwise(F.regexp_replace(s, "[0-9]+", "{n}"))
    return F.transform(F.split(F.regexp_replace(path, "^/", ""), "/"), form)


def template_tree(shapes: DataFrame, *, z2: float = Z2) -> DataFrame:
    """shapes (host, shape, labelled, bad) -> the same with template, the shape after merging, fork by fork from the root.

    t: the shape so far, of which the first `at` segments are settled. The least and the largest t of a branch share what all of it shares, so they tell
    where its next fork is; a branch of one t is done, and so is a shape that ends at a fork."""
    now = written(shapes.select("*", F.col("shape").alias("t"), F.lit(0).alias("at")), "shapes")
    done: list[DataFrame] = []
    while True:
        keyed = now.withColumn("parent", F.array_join(F.slice("t", F.lit(1), F.col("at")), "/"))
        branch = keyed.groupBy("host", "at", "parent").agg(F.min("t").alias("low"), F.max("t").alias("high"))
        fork = F.array_position(F.zip_with("low", "high", lambda a, b: F.coalesce(a == b, F.lit(False))), False).cast("int") - 1
        laid = written(keyed.join(branch.select("host", "at", "parent", F.when(F.col("low") != F.col("high"), fork).alias("fork")), ["host", "at", "parent"]), "forks")
        live = F.col("fork").isNotNull() & (F.size("t") > F.col("fork"))
        columns = ["host", "shape", "labelled", "bad"]
        done.append(laid.where(~live).select(*columns, "t"))
        here = laid.where(live).select(*columns, "t", "fork", F.array_join(F.slice("t", F.lit(1), F.col("fork")), "/").alias("parent"), F.get("t", F.col("fork")).alias("child"))
        if here.isEmpty():
            break
        child = here.groupBy("host", "fork", "parent", "child").agg(F.sum("labelled").alias("cl"), F.sum("bad").alias("cb"))
        parent = child.groupBy("host", "fork", "parent").agg(F.count(F.lit(1)).alias("children"), F.sum("cl").alias("pl"), F.sum("cb").alias("pb"))
        p, c = (F.col("pb") + 0.5) / (F.col("pl") + 1.0), F.col("cb") / F.col("cl")
        alike = (F.col("cl") == 0) | (F.col("cl") * ((c - p) * (c - p)) <= F.lit(z2) * (p * (1.0 - p)))
        merge = child.join(parent, ["host", "fork", "parent"]).where((F.col("children") > 1) & alike).select("host", "fork", "parent", "child", F.lit(True).alias("merge"))
        wild = F.concat(F.slice("t", F.lit(1), F.col("fork")), F.array(F.lit("*")), F.slice("t", F.col("fork") + 2, F.size("t")))
        joined = here.join(merge, ["host", "fork", "parent", "child"], "left").select(*columns, F.when(F.col("merge"), wild).otherwise(F.col("t")).alias("t"), (F.col("fork") + 1).alias("at"))
        last, now = now, written(joined, "shapes")
        dropped(last)
    out = done[0]
    for one in done[1:]:
        out = out.unionByName(one)
    return out.select(*columns, F.concat(F.lit("/"), F.array_join("t", "/")).alias("template"))


def judge(pages: DataFrame, labels: DataFrame, *, rules=RULES, page_id: str = "page_id", url: str = "url", strength: float = STRENGTH, reject: float = REJECT, **tree) -> DataFrame:
    """All columns of pages, and host, path, rule, template, purity (smoothed share of bad pages), verdict.

    labels: (page_id, bad), any number of rows for a page."""
    names = fresh(pages, "host", "path", "rule", "template", "purity", "verdict", "shape_")
    c_host, c_path, c_rule, c_template, c_purity, c_verdict, c_shape = names
    host, path = host_path(F.col(url))
    base = pages.withColumn(c_host, host).withColumn(c_path, path).withColumn(c_shape, shape(F.col(c_path)))
    marks = labels.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy(F.col("page_id").alias("lid")).agg(F.max(F.col("bad").cast("int")).alias("bad"))
    seen = base.select(F.col(page_id).alias("pid"), F.col(c_host).alias("host"), F.col(c_shape).alias("shape")).join(marks, F.col("pid") == F.col("lid"), "left")
    shapes = seen.groupBy("host", "shape").agg(F.count("bad").alias("labelled"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad"))
    tree_ = template_tree(shapes, **tree)
    stat = tree_.groupBy("host", "template").agg(F.sum("labelled").alias("tl"), F.sum("bad").alias("tb"))
    by_host = stat.groupBy("host").agg(F.sum("tl").alias("hl"), F.sum("tb").alias("hb"))
    everywhere = by_host.agg(F.coalesce(F.sum("hl"), F.lit(0)).alias("gl"), F.coalesce(F.sum("hb"), F.lit(0)).alias("gb"))  # one row
    k = F.lit(float(strength))
    g = (F.col("gb") + 1.0) / (F.col("gl") + 2.0)
    h = (F.col("hb") + k * g) / (F.col("hl") + k)
    purity = stat.join(by_host.join(F.broadcast(everywhere), F.lit(True)).select("host", h.alias("hp")), "host").select("host", "template", ((F.col("tb") + k * F.col("hp")) / (F.col("tl") + k)).alias("purity"))
    found = tree_.join(purity, ["host", "template"]).select(F.col("host").alias(c_host), F.col("shape").alias(c_shape), F.col("template").alias(c_template), F.round("purity", 9).alias(c_purity))
    rule, verdict = rule_of(F.col(c_host), F.col(c_path), rules)
    out = base.join(found, [c_host, c_shape], "left")
    return out.withColumn(c_rule, rule).withColumn(c_verdict, F.coalesce(verdict, F.when(F.col(c_purity) > reject, "block").otherwise("allow"))).select(*pages.columns, c_host, c_path, c_rule, c_template, c_purity, c_verdict)


def op8_path_templates(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, labels).select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 6).alias("purity"))


def _oracle() -> str:
    url = URL.replace("'", "''")
    rules = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
    case = lambda i: "CASE " + " ".join(f"WHEN (host = '{r[0]}' OR ends_with(host, '.{r[0]}')) AND starts_with(path, '{r[1]}') THEN '{r[2] if i else r[0] + r[1]}'" for r in rules) + " END"
    form = "CASE WHEN regexp_matches(s, '^[0-9a-fA-F]{8,}$') AND regexp_matches(s, '[0-9]') THEN '{h}' ELSE regexp_replace(s, '[0-9]+', '{n}', 'g') END"
    child, parent = "OVER (PARTITION BY host, i, parent, child)", "OVER (PARTITION BY host, i, parent)"
    sql = f"""WITH RECURSIVE base AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{url}', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '{url}', 2) AS path FROM pages),
shaped AS (SELECT page_id, host, path, list_transform(string_split(regexp_replace(path, '^/', ''), '/'), lambda s: {form}) AS shape FROM base),
marks AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NULL OR toxic IS NULL THEN NULL ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
t0 AS (SELECT host, shape, count(bad) AS labelled, sum(coalesce(bad, 0)) AS bad FROM shaped LEFT JOIN marks ON page_id = doc_id GROUP BY 1, 2),
levels AS (SELECT 0 AS i, host, shape, shape AS t, labelled, bad, (SELECT max(len(shape)) FROM t0) AS deepest FROM t0 UNION ALL
  SELECT i + 1, host, shape, CASE WHEN child IS NOT NULL AND children > 1 AND (cl = 0 OR cl * ((cb / nullif(cl, 0) - p) * (cb / nullif(cl, 0) - p)) <= {Z2}::DOUBLE * (p * (1.0::DOUBLE - p))) THEN list_concat(list_append(t[1:i], '*'), t[i + 2:]) ELSE t END, labelled, bad, deepest
  FROM (SELECT *, sum(labelled) {child} AS cl, sum(bad) {child} AS cb, count(DISTINCT child) {parent} AS children, (sum(CASE WHEN child IS NOT NULL THEN bad END) {parent} + 0.5::DOUBLE) / (sum(CASE WHEN child IS NOT NULL THEN labelled END) {parent} + 1.0::DOUBLE) AS p
    FROM (SELECT *, array_to_string(t[1:i], '/') AS parent, t[i + 1] AS child FROM levels WHERE i < deepest)))"""
    return sql + f""",
tree AS (SELECT host, shape, labelled, bad, '/' || array_to_string(t, '/') AS template FROM levels WHERE i = deepest),
stat AS (SELECT host, template, sum(labelled) AS tl, sum(bad) AS tb FROM tree GROUP BY 1, 2),
g AS (SELECT (sum(tb) + 1.0::DOUBLE) / (sum(tl) + 2.0::DOUBLE) AS g FROM stat),
h AS (SELECT host, (sum(tb) + {STRENGTH}::DOUBLE * max(g)) / (sum(tl) + {STRENGTH}::DOUBLE) AS hp FROM stat, g GROUP BY 1),
pur AS (SELECT host, template, round((tb + {STRENGTH}::DOUBLE * hp) / (tl + {STRENGTH}::DOUBLE), 9) AS purity FROM stat JOIN h USING (host))
SELECT page_id, s.host, path, {case(0).replace("host", "s.host")} AS rule, coalesce({case(1).replace("host", "s.host")}, CASE WHEN purity > {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, tree.template, round(purity, 6) AS purity
FROM shaped s LEFT JOIN tree ON s.host = tree.host AND s.shape = tree.shape LEFT JOIN pur ON tree.host = pur.host AND tree.template = pur.template"""


ORACLE = _oracle()
