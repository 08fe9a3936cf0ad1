"""A corpus pipeline: five stages, each calling one operator of quire.llm.

toxic documents go; one document of each SimHash component stays; personal data get surrogates;
sources are repeated to target weights; what is left is packed into sequences. Each stage takes
(spark, docs, sf_dir) and all rows its predecessor kept. All but the last return the columns of docs.

Cases: a null or empty text isn't toxic, is a near copy of the other wordless texts, holds no personal data, counts as size 0 in its source's
weight and packs as its end id; a null doc_id or source is a value like any other; repeated rows are one near copy, or, further on, rows each;
a very long text is read whole in each stage; an empty table runs through; columns beyond those named are kept up to packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import mixing, packing, pii, simhash, toxicity
from quire.llm.common import dropped, table, written

#: The rule for near copies: words of a shingle, least Jaccard similarity.
SHINGLE, SIMILAR = 5, 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that score at least the production threshold go."""
    return toxicity.drop_toxic(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each component of five-word similarity, the document of the smallest doc_id stays."""
    return simhash.deduplicate(docs, shingle=SHINGLE, similar=SIMILAR)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: every document stays; entities in its text get surrogates, and n_chars is that of the new text."""
    out = pii.replace_pii(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents are repeated, or left out, to the target weights of their sources."""
    return mixing.mix(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: pieces of sequences, with a digest of each piece's ids."""
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("pii", replace_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Levenshtein automata, fingerprint components and surrogates are beyond SQL: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; what each returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = written(stage(spark, docs, sf_dir), f"stage-{name}")
        dropped(docs)  # nothing reads the stage before it any more
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
