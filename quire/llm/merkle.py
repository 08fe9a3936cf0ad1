"""Merkle manifest of a dataset, and proofs by a recursive query (operator 11).

A row's leaf is the SHA-256 of its fields; in each source, leaves in order of doc_id are hashed in runs
of sixteen, level by level, to a subroot, and subroots in order of source likewise to the root. Every
built level is stored as rows that know their parent (`Manifest.nodes`): a node's id is (tree, at), a
source's rank (or -1 above the sources) and level * 2 ** 48 + its place in the level.

A recursive query climbs from the leaves: each round joins a row with the node above it, takes that
node's other children as siblings, and folds the hash. The leaves of a run have all siblings above
their own level in common, so a run climbs as one row that holds its leaves, the fold of each tampered
one, and the fold of the others: a sixteenth of the siblings is moved between rounds. Nodes with many
leaves below are few (their number is checked) and are broadcast; those below are joined by a shuffle,
and none of them has more than a bounded share of the rows, so a source of any size spreads.

Places in order are counted in two steps, within range partitions and before them, so no task sees all rows.

Cases: a null field is the sign `-` (a null source is a source, before all others; null doc_ids come first in
their source); an empty text is `0:`; a very long text is hashed whole; equal doc_ids are ordered by their leaf, and
repeated rows are leaves each; a source of one row has that leaf as its subroot; an empty table gives an empty
one; further columns, whatever their names, are not read."""

from __future__ import annotations

import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, dropped, offsets, shuffle_partitions, table, written

#: Children of a node, fields of a leaf in their order, modulus of the doc_ids whose rows are tampered with.
FAN, FIELDS, TAMPER = 16, ("doc_id", "source", "lang", "n_chars", "text"), 5
#: At most so many node rows (of some 600 bytes) are broadcast.
TOP_NODES = 20_000
LEVEL, DIGEST = 1 << 48, 32
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


class Manifest(NamedTuple):
    """runs: a row for each run of leaves; nodes: the rows above them; root: the digest, null for no rows."""

    runs: DataFrame
    nodes: DataFrame
    root: bytes | None


def digest(b: Column) -> Column:
    """SHA-256 over the lower-case hex text of binary digests laid end to end."""
    return F.unhex(F.sha2(F.lower(F.hex(b)), 256))


def leaf(fields: list[Column]) -> Column:
    """SHA-256 over each field as its bytes, a colon and its value; a null is a dash."""
    texts = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256))


def leaves_of(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", text: str = "text", tamper: int = TAMPER) -> DataFrame:
    """(doc_id, source, leaf, tampered): tampered is the leaf of the lower-cased text, where that is to be and differs."""
    own = [F.col(c) for c in (doc_id, source, lang, n_chars, text)]
    low = F.translate(F.col(text), string.ascii_uppercase, string.ascii_lowercase)
    changed = (crc_mod(F.col(doc_id), tamper) == 0) & (low != F.col(text))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), leaf(own).alias("leaf"), F.when(changed, leaf([*own[:4], low])).alias("tampered"))


def numbered(df: DataFrame, keys: list[str], name: str, number: str) -> DataFrame:
    """df, written, with each row's place from 0 in the order of keys: the place in its range partition and the rows before that."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys)
    laid = written(ranged.withColumn("_id", F.monotonically_increasing_id()), name)
    laid_at = laid.withColumn("_part", F.shiftright("_id", 33)).withColumn("_id", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    before = offsets(laid_at.groupBy("_part").agg(F.count("*").alias("_n")), "_part", "_n")  # a row for each partition
    out = laid_at.join(F.broadcast(before), "_part").select(*df.columns, (F.col("_id") + F.col("before")).alias(number))
    out._quire_path = laid._quire_path
    return out


def linked(rows: DataFrame, level: int, sources: int) -> DataFrame:
    """rows (tree, k, m, ...) with id, parent and place below it: m is the number of nodes of the level in the tree, 1 at its top."""
    at = lambda lv, k: F.lit(lv * LEVEL) + k
    top, single = F.col("m") == 1, F.lit(sources == 1)
    k = F.when(top, F.col("tree")).otherwise(F.col("k"))
    return rows.withColumns(
        {
            "at": at(level, F.col("k")),
            "up_tree": F.when(top & ((F.col("tree") < 0) | single), F.lit(None).cast("long")).otherwise(F.when(top, F.lit(-1)).otherwise(F.col("tree")).cast("long")),
            "up_at": F.when(top & ((F.col("tree") < 0) | single), F.lit(None).cast("long")).otherwise(F.when(top, at(1, F.floor(k / FAN))).otherwise(at(level + 1, F.floor(k / FAN)))),
            "pos": (k % FAN).cast("int"),
        }
    )


def raised(rows: DataFrame) -> DataFrame:
    """The next level of (tree, k, m, hash, w): every FAN consecutive nodes of a tree that has several become one."""
    byplace = F.sort_array(F.collect_list(F.struct("k", "hash")))
    up = rows.where("m > 1").groupBy("tree", F.floor(F.col("k") / FAN).alias("k")).agg(F.first("m").alias("m"), F.sum("w").alias("w"), byplace.alias("c"))
    up = up.withColumn("children", F.unhex(F.array_join(F.transform("c", lambda x: F.hex(x["hash"])), "")))
    return up.select("tree", "k", F.ceil(F.col("m") / FAN).alias("m"), digest(F.col("children")).alias("hash"), "w", "children")


def levels_above(rows: DataFrame, widest: int, level: int, sources: int) -> tuple[list[DataFrame], DataFrame]:
    """The written levels above rows, whose widest tree has `widest` nodes, and the tops of all trees (tree, hash, w)."""
    levels, tops = [], rows.where("m = 1").select("tree", "hash", "w")
    while widest > 1:
        level, widest = level + 1, -(-widest // FAN)
        rows = written(linked(raised(rows), level, sources), "level")
        levels.append(rows)
        tops = tops.unionByName(rows.where("m = 1").select("tree", "hash", "w"))
    return levels, tops


def build(leaves: DataFrame) -> Manifest:
    """The manifest of leaves (doc_id, source, leaf, tampered)."""
    spark = leaves.sparkSession
    plain = written(leaves, "leaves")
    laid = numbered(plain, ["source", "doc_id", "leaf"], "ordered", "nth")
    by_source = written(laid.groupBy("source").agg(F.count("*").alias("m"), F.min("nth").alias("first")), "sources")
    dropped(plain)
    ranked = numbered(by_source, ["first"], "ranked", "tree")
    sources, widest = ranked.agg(F.count("*"), F.max("m")).first()
    rows = laid.join(ranked.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    pos = F.col("nth") - F.col("first")
    own = F.sort_array(F.collect_list(F.struct(pos.alias("nth"), "doc_id", "leaf", "tampered")))
    runs = rows.groupBy("tree", F.floor(pos / FAN).alias("k")).agg(F.first("m").alias("n"), own.alias("leaves"))
    runs = runs.withColumn("all", F.unhex(F.array_join(F.transform("leaves", lambda x: F.hex(x["leaf"])), "")))
    lone = F.col("n") == 1  # no run: the leaf is the subroot
    before, after = (lambda i: F.substring(F.col("all"), F.lit(1), i * DIGEST)), (lambda i: F.substring(F.col("all"), i * DIGEST + DIGEST + 1, F.length("all")))
    folds = F.transform("leaves", lambda x, i: F.when(lone, x["tampered"]).otherwise(digest(F.concat(before(i), x["tampered"], after(i)))))
    runs = runs.select(
        "tree", "k", F.when(lone, F.lit(1)).otherwise(F.ceil(F.col("n") / FAN)).cast("long").alias("m"), F.when(lone, F.col("all")).otherwise(digest(F.col("all"))).alias("hash"),
        F.size("leaves").cast("long").alias("w"), "leaves", "all", folds.alias("folds"),
    )
    runs = written(linked(runs, 1, sources), "runs")
    for t in (laid, by_source, ranked):
        dropped(t)
    widest = -(-widest // FAN) if widest else 1
    levels, tops = levels_above(runs.select("tree", "k", "m", "hash", "w"), widest, 1, sources)
    subroots = tops.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("k"), F.lit(sources).cast("long").alias("m"), "hash", "w")
    above, roots = levels_above(subroots, sources, 0, 2)
    found = roots.select("hash").first()
    shape = ["tree", "at", "up_tree", "up_at", "pos", "children", "w", F.when((F.col("tree") >= 0) & (F.col("m") == 1), F.col("hash")).alias("subroot")]
    empty = spark.createDataFrame([], "tree long, at long, up_tree long, up_at long, pos int, children binary, w long, subroot binary")
    nodes = empty
    for one in (*levels, *above):
        nodes = nodes.unionByName(one.select(*shape))
    return Manifest(runs, nodes, bytes(found[0]) if found else None)


#: What a climbing row is, and what a join with the node above makes of it.
_STATE = "all, leaves, folds, plain, siblings, subroot, up_tree, up_at, pos"
_HASHED = "unhex(sha2(lower(hex(concat(substring(n.children, 1, c.pos * 32), {}, substring(n.children, c.pos * 32 + 33, 512)))), 256))"
_CLIMB = f"""
WITH RECURSIVE climb ({_STATE}, waits) AS (
  SELECT {_STATE}, up_at IS NULL FROM {{runs}}
  UNION ALL
  SELECT c.all, c.leaves, if(n.at IS NULL, c.folds, transform(c.folds, f -> {_HASHED.format("f")})), if(n.at IS NULL, c.plain, {_HASHED.format("c.plain")}),
    if(n.at IS NULL, c.siblings, concat(c.siblings, substring(n.children, 1, c.pos * 32), substring(n.children, c.pos * 32 + 33, 512))),
    coalesce(c.subroot, n.subroot), if(n.at IS NULL, c.up_tree, n.up_tree), if(n.at IS NULL, c.up_at, n.up_at), if(n.at IS NULL, c.pos, n.pos), n.up_at IS NULL
  FROM climb c LEFT JOIN {{nodes}} n ON n.tree = c.up_tree AND n.at = c.up_at
  WHERE NOT c.waits)
SELECT {_STATE} FROM climb WHERE waits"""


def climb(runs: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """runs after all nodes of `nodes` above them, written; a row waits where its next node isn't among those, or there is none."""
    spark: SparkSession = runs.sparkSession
    limit = spark.conf.get(ROW_LIMIT, None)
    spark.conf.set(ROW_LIMIT, "-1")  # rows grow with the table
    try:
        return written(spark.sql(_CLIMB, runs=runs, nodes=nodes), name)
    finally:
        spark.conf.unset(ROW_LIMIT) if limit is None else spark.conf.set(ROW_LIMIT, limit)


def least_weight(nodes: DataFrame, most: int) -> int:
    """The least power of two such that at most `most` nodes have as many leaves below them; the root always counts."""
    bits = nodes.groupBy(F.length(F.bin("w")).alias("bits")).count().orderBy(F.desc("bits")).collect()  # 63 rows at most
    total, least = 0, 1
    for k, r in enumerate(bits):
        total += r["count"]
        if total > most and k:
            return least
        least = 1 << (r["bits"] - 1)
    return 1


def proofs(manifest: Manifest, *, top_nodes: int = TOP_NODES) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, folded_root): digests as binary, proof: the siblings' digests laid end to end."""
    start = manifest.runs.select(
        "all", "leaves", "folds", F.col("hash").alias("plain"), F.lit(b"").alias("siblings"), F.when(F.col("m") == 1, F.col("hash")).alias("subroot"), "up_tree", "up_at", "pos"
    )
    least = least_weight(manifest.nodes, top_nodes)
    light, heavy = manifest.nodes.where(F.col("w") < least), manifest.nodes.where(F.col("w") >= least)
    low = climb(start, light, "low") if least > 1 else start
    done = climb(low, F.broadcast(heavy), "climbed")
    dropped(low)
    one = done.select("all", "siblings", "subroot", "plain", "folds", F.posexplode("leaves").alias("i", "x"))
    own = F.when(F.length("all") > DIGEST, F.concat(F.expr("substring(all, 1, i * 32)"), F.expr("substring(all, i * 32 + 33, 512)"))).otherwise(F.lit(b""))
    return one.select(
        F.col("x.doc_id").alias("doc_id"), F.col("x.leaf").alias("leaf"), "subroot", F.lit(manifest.root).alias("root"), F.concat(own, "siblings").alias("proof"),
        F.coalesce(F.expr("folds[i]"), "plain").alias("folded_root"),
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = build(leaves_of(table(spark, sf_dir, "documents")))
    out = proofs(manifest)
    text = lambda c: F.lower(F.hex(c)).alias(c)
    proof = F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256")
    return out.select("doc_id", text("leaf"), text("subroot"), text("root"), proof, text("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified"))


_CRC = """SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n::BIGINT)) AS crc"""
_FIELD = "coalesce(strlen({0})::VARCHAR || ':' || {0}, '-')"
_LEAF = " || ".join(_FIELD.format(c) for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", "{text}"))
_LOW = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_FRAME = "OVER (PARTITION BY tree, level, k // 16 ORDER BY k ROWS BETWEEN {})"
ORACLE = f"""
WITH RECURSIVE crc AS ({_CRC}),
fields AS (SELECT doc_id, source, sha256({_LEAF.format(text="text")}) AS leaf, CASE WHEN doc_id IS NOT NULL AND
    xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % {TAMPER} = 0
    THEN sha256({_LEAF.format(text=_LOW)}) END AS tampered FROM documents, crc),
leaves AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, count(*) OVER (PARTITION BY source) AS m FROM fields),
own AS (SELECT tree, 0 AS level, k, m, leaf AS hash FROM leaves
  UNION ALL SELECT tree, level + 1, k // {FAN}, (any_value(m) + {FAN - 1}) // {FAN}, sha256(string_agg(hash, '' ORDER BY k)) FROM own WHERE m > 1 GROUP BY tree, level, k // {FAN}),
top AS (SELECT -1 AS tree, 0 AS level, tree AS k, count(*) OVER () AS m, hash FROM own WHERE m = 1
  UNION ALL SELECT tree, level + 1, k // {FAN}, (any_value(m) + {FAN - 1}) // {FAN}, sha256(string_agg(hash, '' ORDER BY k)) FROM top WHERE m > 1 GROUP BY tree, level, k // {FAN}),
nodes AS (SELECT *, coalesce(string_agg(hash, '') {_FRAME.format("UNBOUNDED PRECEDING AND 1 PRECEDING")}, '') AS l, coalesce(string_agg(hash, '') {_FRAME.format("1 FOLLOWING AND UNBOUNDED FOLLOWING")}, '') AS r
  FROM (SELECT * FROM own UNION ALL SELECT * FROM top)),
climb AS (SELECT tree AS t, k AS id, tree, 0 AS level, k, coalesce(tampered, leaf) AS fold, '' AS proof, false AS over FROM leaves
  UNION ALL SELECT t, id, CASE WHEN n.m = 1 THEN -1 ELSE n.tree END, CASE WHEN n.m = 1 THEN 0 ELSE n.level + 1 END, CASE WHEN n.m = 1 THEN n.tree ELSE n.k // {FAN} END,
    CASE WHEN n.m = 1 THEN fold ELSE sha256(l || fold || r) END, proof || CASE WHEN n.m = 1 THEN '' ELSE l || r END, n.m = 1 AND n.tree < 0
  FROM climb c JOIN nodes n ON n.tree = c.tree AND n.level = c.level AND n.k = c.k WHERE NOT over)
SELECT doc_id, leaf, s.hash AS subroot, root.hash AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root.hash AS verified
FROM leaves v JOIN climb c ON c.t = v.tree AND c.id = v.k AND c.over JOIN own s ON s.tree = v.tree AND s.m = 1, (SELECT hash FROM top WHERE m = 1) root
"""
