"""Mixing sources to target weights by Poisson replication (operator 2).

Every document is repeated by a Poisson count whose mean is its source's target repetition rate.
The count inverts the Poisson distribution at a uniform number hashed from seed and doc_id, so a
rerun, or another engine, gets the same counts. All copies are then dealt out by a hash of
(seed, doc_id, copy), which is the global shuffle. DataFrame functions only.

Cases: a null source is a source of its own; a null doc_id hashes as the empty text; a null text
has size 0, a very long one counts by its characters; repeated rows each get the same count; an empty table gives an empty one; all columns
of the input are kept, and the new ones take a leading underscore where a name is taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, table, written

TEMPERATURE, SEED = 0.5, "mix-1"
#: Up to so many numbers in all, 32 MB, the sources' distributions are broadcast; beyond, they are joined by a shuffle.
BROADCAST_NUMBERS = 4_000_000
#: A higher rate is a sum of equal Poisson counts of at most this rate, each with its own hash.
MOST_RATE = 1_000.0


def uniform(key: Column, seed: str) -> Column:
    """52 bits of md5 as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def distribution(rate: str) -> str:
    """SQL for the Poisson distribution function of `rate` at 0, 1, ... until its tail is beyond 52 bits."""
    term = f"exp(k * ln({rate}) - {rate} - (a.f + if(k > 1, ln(k), 0D)))"
    return f"""if({rate} <= 0, array(1D), aggregate(sequence(0, cast(ceil({rate} + 12 * sqrt({rate}) + 20) as int)),
        named_struct('f', 0D, 'c', 0D, 'cdf', cast(array() as array<double>)),
        (a, k) -> named_struct('f', a.f + if(k > 1, ln(k), 0D), 'c', a.c + {term}, 'cdf', concat(a.cdf, array(a.c + {term}))), a -> a.cdf))"""


def rates(docs: DataFrame, weights: dict[str, float] | None = None, *, epochs: float = 1.0, temperature: float = TEMPERATURE, source: str = "source", text: str = "text") -> DataFrame:
    """(src, size, rate): target share x epochs x all characters / the source's characters.

    weights: share of each source (others get 0); without them, shares go as size ** temperature."""
    size = docs.groupBy(F.col(source).alias("src")).agg(F.sum(F.coalesce(F.length(text), F.lit(0))).cast("double").alias("size"))
    if weights is None:
        size = size.withColumn("w", F.when(F.col("size") > 0, F.round(F.pow("size", F.lit(float(temperature))), 6)).otherwise(0.0))
    else:
        m = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]) if weights else F.create_map().cast("map<string,double>")
        size = size.withColumn("w", F.coalesce(F.try_element_at(m, F.coalesce("src", F.lit(""))), F.lit(0.0)))
    total = size.agg(F.sum("size").alias("all_size"), F.round(F.sum("w"), 3).alias("all_w"))  # one row
    rate = F.when((F.col("size") > 0) & (F.col("all_w") > 0), F.round(F.col("w") / F.col("all_w") * F.lit(float(epochs)) * F.col("all_size") / F.col("size"), 9)).otherwise(0.0)
    return size.join(F.broadcast(total), F.lit(True)).select("src", "size", rate.alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, *, epochs: float = 1.0, temperature: float = TEMPERATURE, seed: str = SEED, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """All columns of docs, and copy_no (from 1), rate and mix_key, one row for each copy, shuffled globally.

    Rows are dealt to partitions by mix_key and lie in its order there."""
    c_rate, c_cdf, c_src, c_copy, c_key, c_parts = fresh(docs, "rate", "cdf", "src", "copy_no", "mix_key", "parts")
    table_ = written(rates(docs, weights, epochs=epochs, temperature=temperature, source=source, text=text), "rates")
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST_RATE)).cast("int")
    small = table_.withColumn("p", parts).select(F.col("src").alias(c_src), F.col("rate").alias(c_rate), F.col("p").alias(c_parts), F.expr(distribution("(rate / p)")).alias(c_cdf))
    if (small.agg(F.sum(F.size(c_cdf))).first()[0] or 0) <= BROADCAST_NUMBERS:
        small = F.broadcast(small)
    joined = docs.join(small, docs[source].eqNullSafe(small[c_src]), "inner")
    one = lambda u: F.size(F.filter(c_cdf, lambda c: c <= u))  # noqa: E731  inverts the distribution at u
    more = F.aggregate(F.sequence(F.lit(2), F.col(c_parts)), F.lit(0), lambda a, j: a + one(uniform(F.concat_ws("|", j.cast("string"), F.col(doc_id).cast("string")), seed)))
    count = one(uniform(F.col(doc_id), seed)) + F.when(F.col(c_parts) > 1, more).otherwise(0)
    out = joined.withColumn(c_copy, F.explode(F.when(count > 0, F.sequence(F.lit(1), count))))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col(c_copy).cast("string")))
    return out.withColumn(c_key, key).drop(c_src, c_cdf, c_parts).repartition(c_key).sortWithinPartitions(c_key)


def op2_poisson_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "copy_no", F.round("rate", 6).alias("rate"), "mix_key")


ORACLE = f"""
WITH size AS (SELECT source AS src, coalesce(sum(coalesce(length(text), 0)), 0)::DOUBLE AS size FROM documents GROUP BY 1),
w AS (SELECT *, CASE WHEN size > 0 THEN round(pow(size, {TEMPERATURE}), 6) ELSE 0 END AS w FROM size),
r AS (SELECT src, CASE WHEN size > 0 AND (SELECT sum(w) FROM w) > 0 THEN round(w / (SELECT round(sum(w), 3) FROM w) * 1.0::DOUBLE * (SELECT sum(size) FROM w) / size, 9) ELSE 0 END AS rate FROM w),
terms AS (SELECT src, rate, k, CASE WHEN rate > 0 THEN exp(k * ln(rate) - rate - lgamma(k + 1)) ELSE 1 END AS p
  FROM r, LATERAL (SELECT unnest(generate_series(0, CASE WHEN rate > 0 THEN ceil(rate + 12 * sqrt(rate) + 20)::INT ELSE 0 END)) AS k)),
cdf AS (SELECT src, rate, k, sum(p) OVER (PARTITION BY src ORDER BY k) AS c FROM terms),
lists AS (SELECT src, rate, list(c ORDER BY k) AS cdf FROM cdf GROUP BY 1, 2),
n AS (SELECT d.doc_id, d.source, rate, len(list_filter(cdf, lambda c: c <= ('0x' || substr(md5('{SEED}|' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)) AS n
  FROM documents d JOIN lists ON d.source IS NOT DISTINCT FROM src)
SELECT doc_id, source, copy_no::INT AS copy_no, round(rate, 6) AS rate, md5('{SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || copy_no::VARCHAR) AS mix_key
FROM (SELECT doc_id, source, rate, unnest(generate_series(1, n)) AS copy_no FROM n)
"""
