"""Matching by several vectors of a unit, by the evidence of neighbours, and the selection of ids under a joint cap.

A unit here is four vectors of the given table, its spans; the first stands for its whole text. Units lie in documents of 25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.structures import COSINE, EVIDENCE_LIKE, blocks_of, dot, mean_of, unit
from quire.plans.registry import query
from quire.sources import views as V

SPANS, UNITS_A_DOC, EACH = 4, 25, 10
#: Best units that a search keeps, and how far a unit's neighbours reach.
KEPT, REACH = 8, 3


def late_interaction(asked: DataFrame, rows: DataFrame, kept: int = KEPT) -> DataFrame:
    """(query, unit, cosine, coverage, score): of each asked unit the `kept` other units of largest score, ties to smaller units.

    asked, rows: (unit, span, u) with vectors of length one; span 0 is the text's own. Coverage is the mean over the asked unit's spans of
    the largest likeness among the other's spans; the score is the larger of that and the cosine of the texts; all to five places.
    Blocks of asked units meet blocks of units; a block keeps its best, and these are merged."""
    columns = "query long, unit long, cosine double, coverage double, score double"

    def best(asks, have):
        import numpy as np
        import pandas as pd

        out = []
        if len(asks) and len(have):
            asks, have = (x.sort_values(["unit", "span"], ignore_index=True) for x in (asks, have))
            ids, starts = np.unique(have["unit"], return_index=True)
            x, own = np.stack(have["u"]), (have["span"] == 0).to_numpy().nonzero()[0]
            texts = dict(zip(have["unit"].to_numpy()[own], own, strict=True))
            at = np.array([texts.get(i, -1) for i in ids])
            for q, spans in asks.groupby("unit"):
                like = np.stack(spans["u"]) @ x.T
                coverage = np.round(np.maximum.reduceat(like, starts, axis=1).mean(axis=0), 5)
                first = (spans["span"] == 0).to_numpy()
                cosine = np.where(at >= 0, np.round(like[first.argmax()][at], 5), -1.0) if first.any() else np.full(len(ids), -1.0)
                score = np.maximum(coverage, cosine)
                order = np.lexsort((ids, -score))[: kept + 1]
                out.append(pd.DataFrame({"query": q, "unit": ids[order], "cosine": cosine[order], "coverage": coverage[order], "score": score[order]}))
        found = pd.concat(out) if out else pd.DataFrame({c.split()[0]: [] for c in columns.split(", ")})
        return found[found["query"] != found["unit"]].astype({"query": "int64", "unit": "int64", "cosine": "float64", "coverage": "float64", "score": "float64"})

    q, r = blocks_of(asked, rows, "unit")
    found = q.groupBy("q", "r").cogroup(r.groupBy("q", "r")).applyInPandas(best, columns)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "unit")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= kept).drop("place")


def span_vectors(spark, sf_dir) -> DataFrame:
    """(unit, span, u): the multi-vector table."""
    e = V.table(spark, sf_dir, "embeddings").withColumn("u", unit(F.col("embedding"))).where("u IS NOT NULL AND vec_id IS NOT NULL")
    return e.select(F.floor(F.col("vec_id") / SPANS).alias("unit"), (F.col("vec_id") % SPANS).cast("int").alias("span"), "u")


_PAIRS = f"SELECT a.vec_id // {SPANS} AS query, b.vec_id // {SPANS} AS unit, a.vec_id % {SPANS} AS s, b.vec_id % {SPANS} AS t, {COSINE} AS c FROM embeddings a JOIN embeddings b ON a.vec_id // {SPANS} % {EACH} = 0 AND a.vec_id // {SPANS} <> b.vec_id // {SPANS}"
LATE = f"SELECT *, greatest(cosine, coverage) AS score FROM (SELECT query, unit, round(max(own), 5) AS cosine, round(avg(m), 5) AS coverage FROM (SELECT query, unit, s, max(c) AS m, max(c) FILTER (WHERE s = 0 AND t = 0) AS own FROM ({_PAIRS}) GROUP BY 1, 2, 3) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, unit) <= {KEPT}"


@query(f"SELECT query, unit, cosine, coverage, score FROM ({LATE})")
def span_coverage(spark, sf_dir):
    """Every tenth unit's best units by their spans."""
    v = span_vectors(spark, sf_dir)
    return late_interaction(v.where(F.col("unit") % EACH == 0), v)


def with_neighbours(pool: DataFrame, texts: DataFrame, reach: int = REACH, like: float = EVIDENCE_LIKE) -> DataFrame:
    """(query, unit, neighbours, score) of a pool (query, unit, cosine): a unit's score is at least its mean with those of the query's neighbours that are like it.

    texts: (doc, ord, unit, u). Neighbours are the units up to `reach` before and after the query in its document."""
    at = texts.select("doc", "ord", F.col("unit").alias("query"))
    steps = F.array(*[F.lit(d) for d in range(-reach, reach + 1) if d])
    around = at.withColumn("ord", F.explode(F.transform(steps, lambda d: F.col("ord") + d))).join(texts.select("doc", "ord", F.col("u").alias("n")), ["doc", "ord"]).select("query", "n")
    sims = pool.join(around, "query").join(texts.select("unit", "u"), "unit").select("query", "unit", F.round(F.round(dot(F.col("n"), F.col("u")), 5) * 100000).cast("long").alias("c"))
    near = sims.where(F.col("c") >= round(like * 100000)).groupBy("query", "unit").agg(F.sum("c").alias("s"), F.count(F.lit(1)).alias("n"))
    own = F.round(F.col("cosine") * 100000).cast("long")
    joined = pool.join(near, ["query", "unit"], "left")
    evidence = F.when(F.col("n") > 0, mean_of(F.col("s") + own, F.col("n") + 1))
    return joined.select("query", "unit", F.coalesce("n", F.lit(0)).cast("long").alias("neighbours"), F.greatest(own / 100000.0, F.coalesce(evidence, F.lit(-1.0))).alias("score"))


@query(f"""WITH late AS ({LATE}), sims AS (SELECT l.query, l.unit, l.cosine, round(round({COSINE}, 5) * 100000)::BIGINT AS c FROM late l JOIN embeddings b ON b.vec_id = l.unit * {SPANS}
JOIN (SELECT *, vec_id // {SPANS} AS n FROM embeddings WHERE vec_id % {SPANS} = 0) a ON a.n <> l.query AND abs(a.n - l.query) <= {REACH} AND a.n // {UNITS_A_DOC} = l.query // {UNITS_A_DOC}),
near AS (SELECT query, unit, sum(c) AS s, count(*) AS n FROM sims WHERE c >= {round(EVIDENCE_LIKE * 100000)} GROUP BY 1, 2)
SELECT l.query, l.unit, coalesce(n, 0) AS neighbours, greatest(round(cosine * 100000)::BIGINT / 100000.0::DOUBLE, coalesce(floor(((s + round(cosine * 100000)::BIGINT) * 20 + n + 1) / (2 * (n + 1))) / 1000000, -1)) AS score FROM late l LEFT JOIN near USING (query, unit)""")
def neighbor_evidence(spark, sf_dir):
    """The best units of a query, scored by what the units around the query say of them."""
    v = span_vectors(spark, sf_dir)
    pool = late_interaction(v.where(F.col("unit") % EACH == 0), v).select("query", "unit", "cosine")
    texts = v.where("span = 0").select(F.floor(F.col("unit") / UNITS_A_DOC).alias("doc"), F.col("unit").alias("ord"), "unit", "u")
    return with_neighbours(pool, texts)


# ---- selection of ids under a joint cap ----------------------------------------------------------

#: Ids of a request over both roles; how far behind the best a second candidate may be.
CAP, SECOND = 32, 0.12


def selection(ranked: DataFrame, near: DataFrame, asked: DataFrame, cap: int = CAP) -> DataFrame:
    """(request, role, id, place): the asked ids, then each one's candidates, then what lies around an id and its best candidate and is accepted.

    asked: (request, nth, role, id); ranked: (request, nth, role, id, k), candidates by rank; near: (request, nth, side, step, role, id), accepted
    neighbours, the source's side (0) before the target's (1), following ones before earlier ones by step. Whether an id is accepted doesn't depend on
    what was taken before; so the fold that adds ids until the cap is the order of first places."""
    z, low = F.lit(0), lambda c: F.col(c).cast("int")
    key = lambda *c: F.struct(*[x.alias(f"k{i}") for i, x in enumerate(c)]).alias("key")
    every = asked.select("request", "role", "id", key(z, low("nth"), z, z))
    every = every.unionByName(ranked.select("request", "role", "id", key(z + 1, low("nth"), z, low("k"))))
    every = every.unionByName(near.select("request", "role", "id", key(z + 2, low("nth"), low("side"), low("step"))))
    first = every.groupBy("request", "role", "id").agg(F.min("key").alias("key"))
    w = Window.partitionBy("request").orderBy("key", "role", "id")
    return first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= cap).select("request", "role", "id", "place")


def best_of(asked: DataFrame, rows: DataFrame, kept: int) -> DataFrame:
    """(query, unit, cosine, k): the `kept` nearest rows (unit, u) of each asked (unit, u)."""
    found = late_interaction(asked.select("unit", F.lit(0).alias("span"), "u"), rows.select("unit", F.lit(0).alias("span"), "u"), kept)
    return found.select("query", "unit", "cosine", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "unit")).alias("k"))


def around(df: DataFrame, of: str, vectors: DataFrame, name: str) -> DataFrame:
    """df with the ids (name, u) up to REACH places around df[of] in its role and document, and their step: following ones, then earlier ones, nearest first."""
    steps = [(2 * d, d) for d in range(1, REACH + 1)] + [(-2 * d, REACH + d) for d in range(1, REACH + 1)]
    moves = F.inline(F.array(*[F.struct(F.lit(by).alias("by"), F.lit(step).alias("step")) for by, step in steps]))
    near = df.select("*", moves).withColumn(name, F.col(of) + F.col("by"))
    same_doc = document(F.col(name)) == document(F.col(of))
    return near.where(same_doc).join(vectors.select(F.col("vec_id").alias(name), F.col("u").alias(f"{name}_u")), name).drop("by")


def document(v: Column) -> Column:
    return F.floor(v / 100)


_ROLE = "CASE WHEN {0} % 2 = 0 THEN 'source' ELSE 'target' END"
_COS = COSINE.replace("a.embedding", "{0}.embedding").replace("b.embedding", "{1}.embedding")
_STEP = f"CASE WHEN {{0}} > {{1}} THEN ({{0}} - {{1}}) // 2 ELSE {REACH} + ({{1}} - {{0}}) // 2 END"


@query(f"""WITH av AS (SELECT * FROM embeddings WHERE vec_id % 9 <> 4), asked AS (SELECT vec_id, vec_id // 200 AS request FROM av WHERE vec_id % 50 = 0),
side AS (SELECT q.vec_id AS query, q.request, n.* FROM asked q JOIN av n ON n.vec_id % 2 = 0 AND n.vec_id <> q.vec_id AND abs(n.vec_id - q.vec_id) <= {2 * REACH} AND n.vec_id // 100 = q.vec_id // 100),
looking AS (SELECT vec_id, embedding FROM av WHERE vec_id IN (SELECT vec_id FROM asked) UNION SELECT vec_id, embedding FROM side),
best AS (SELECT * FROM (SELECT a.vec_id AS query, b.vec_id, round({COSINE}, 5) AS cosine FROM looking a JOIN av b ON b.vec_id % 2 = 1) QUALIFY row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id) <= 2),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id) AS k, max(cosine) OVER (PARTITION BY query) AS top FROM best),
ranked AS (SELECT request, query, k.vec_id, k FROM k JOIN asked ON asked.vec_id = query WHERE k = 1 OR cosine >= top - {SECOND}::DOUBLE),
tops AS (SELECT request, r.query, r.vec_id AS top, e.embedding FROM ranked r JOIN av e ON e.vec_id = r.vec_id WHERE k = 1),
near AS (SELECT t.request, t.query, 0 AS side, {_STEP.format("s.vec_id", "t.query")} AS step, s.vec_id FROM tops t JOIN side s ON s.query = t.query JOIN k ON k.query = s.vec_id AND k.k = 1 WHERE round({_COS.format("s", "t")}, 5) >= {EVIDENCE_LIKE}::DOUBLE OR k.vec_id = t.top
UNION ALL SELECT t.request, t.query, 1, {_STEP.format("n.vec_id", "t.top")}, n.vec_id FROM tops t JOIN av n ON n.vec_id % 2 = 1 AND n.vec_id <> t.top AND abs(n.vec_id - t.top) <= {2 * REACH} AND n.vec_id // 100 = t.top // 100 AND n.vec_id // 20 = t.top // 20 JOIN av q ON q.vec_id = t.query WHERE round({_COS.format("q", "n")}, 5) >= {EVIDENCE_LIKE}::DOUBLE)
SELECT request, {_ROLE.format("id")} AS role, id, place FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY key, id % 2, id) AS place FROM (SELECT request, id, min(key) AS key FROM (
SELECT request, vec_id AS id, [0, vec_id, 0, 0] AS key FROM asked UNION ALL SELECT request, vec_id, [1, query, 0, k] FROM ranked UNION ALL SELECT request, vec_id, [2, query, side, step] FROM near) GROUP BY 1, 2)) WHERE place <= {CAP}""")
def expand_selection(spark, sf_dir):
    """Requests of four source ids, each with its candidates and the accepted neighbours on both sides, 32 ids at most.

    A neighbour of a source id is accepted if it is like the id's best candidate, or has that as its own best; a neighbour of the candidate if it is like the source id and of the candidate's section."""
    e = V.table(spark, sf_dir, "embeddings").withColumn("u", unit(F.col("embedding"))).where("u IS NOT NULL AND vec_id % 9 <> 4").select("vec_id", "u")
    source, target = e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1").select(F.col("vec_id").alias("unit"), "u")
    asked = source.where("vec_id % 50 = 0").select(F.floor(F.col("vec_id") / 200).alias("request"), "vec_id", "u")
    side = around(asked.select("request", "vec_id"), "vec_id", source, "n")
    looking = asked.select(F.col("vec_id").alias("unit"), "u").unionByName(side.select(F.col("n").alias("unit"), F.col("n_u").alias("u")).dropDuplicates(["unit"])).dropDuplicates(["unit"])
    best = best_of(looking, target, 2)
    top = best.withColumn("top", F.max("cosine").over(Window.partitionBy("query"))).where((F.col("k") == 1) | (F.col("cosine") >= F.col("top") - SECOND))
    ranked = top.join(asked.select("request", F.col("vec_id").alias("query")), "query").select("request", F.col("query").alias("nth"), F.lit("target").alias("role"), F.col("unit").alias("id"), "k")
    tops = ranked.where("k = 1").select("request", F.col("nth").alias("query"), F.col("id").alias("top")).join(target.select(F.col("unit").alias("top"), F.col("u").alias("top_u")), "top")
    like = lambda x, y: F.round(dot(F.col(x), F.col(y)), 5) >= EVIDENCE_LIKE
    theirs = best.where("k = 1").select(F.col("query").alias("n"), F.col("unit").alias("n_best"))
    one = side.withColumnRenamed("vec_id", "query").drop("request").join(tops, "query").join(theirs, "n").where(like("n_u", "top_u") | (F.col("n_best") == F.col("top")))
    two = around(tops.drop("top_u"), "top", e, "n").where(F.floor(F.col("n") / 20) == F.floor(F.col("top") / 20)).join(asked.select(F.col("vec_id").alias("query"), "u"), "query").where(like("u", "n_u"))
    rows = lambda df, k, role: df.select("request", F.col("query").alias("nth"), F.lit(k).alias("side"), "step", F.lit(role).alias("role"), F.col("n").alias("id"))
    first = asked.select("request", F.col("vec_id").alias("nth"), F.lit("source").alias("role"), F.col("vec_id").alias("id"))
    return selection(ranked, rows(one, 0, "source").unionByName(rows(two, 1, "target")), first)
