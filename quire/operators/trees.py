"""Trees of nodes and parents without their closure: pointer jumping that carries values, sizes, and the walk in pre-order.

Each round doubles how far up a node has looked, and holds one row a node: a tree of depth d takes log2(d) rounds.
Nodes on a cycle, or below one, have no root; where that matters is said below."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.plans.registry import query
from quire.sources import views as V
from quire.sources.files import settled, unsettled

#: How a value carried so far joins that of the next stretch above it.
Joined = Callable[[Column, Column], Column]
LATER = {"any": lambda a, b: a | b, "sum": lambda a, b: a + b, "nearest": lambda a, b: F.coalesce(a, b)}


def rounds_for(edges: DataFrame) -> int:
    """Rounds after which every node of a tree has met its root."""
    return max(1, edges.count()).bit_length() + 1


def climb(edges: DataFrame, values: dict[str, tuple[Column, str | Joined]]) -> DataFrame:
    """(child, root, *values) of every node that has a parent: each value put together over all its ancestors, the nearest first.

    edges: (child, parent, ...), one row for each child, roots with a null parent; a parent without a row is a root whose values are null.
    values: name -> (what a node is worth, how two stretches join: "any", "sum", "nearest" or a function). A value must not be null unless it is
    joined by "nearest". Nodes on or below a cycle have a null root and null values."""
    names = list(values)
    join = {n: LATER[how] if isinstance(how, str) else how for n, (_, how) in values.items()}
    own = edges.select(F.col("child").alias("up"), F.col("parent").alias("above"), *[v.alias(n) for n, (v, _) in values.items()])
    start = edges.where("parent IS NOT NULL").select("child", F.col("parent").alias("up")).join(own, "up", "left")
    # up: where to look next, null if the root is met
    state = settled(start.select("child", F.when(F.col("above").isNull(), F.col("up")).alias("root"), F.when(F.col("above").isNotNull(), F.col("up")).alias("up"), *names))
    done, active = state.where("up IS NULL"), state.where("up IS NOT NULL")
    for _ in range(rounds_for(edges)):
        if active.isEmpty():
            return done.select("child", "root", *names)
        far = done.unionByName(active).select(F.col("child").alias("up"), F.col("up").alias("next"), F.col("root").alias("top"), *[F.col(n).alias(f"_{n}") for n in names])
        met = active.join(far, "up").select("child", F.col("top").alias("root"), F.col("next").alias("up"), *[join[n](F.col(n), F.col(f"_{n}")).alias(n) for n in names])
        state = settled(met)
        done, active = done.unionByName(state.where("up IS NULL")), state.where("up IS NOT NULL")
    kinds = dict(active.dtypes)
    lost = active.select("child", F.lit(None).cast(kinds["root"]).alias("root"), *[F.lit(None).cast(kinds[n]).alias(n) for n in names])
    return done.select("child", "root", *names).unionByName(lost)


def sizes(edges: DataFrame) -> DataFrame:
    """(child, size): how many nodes a node's tree holds, itself included. edges must hold no cycle.

    After k rounds a node has counted what lies less than 2 ** k below it, and knows the node 2 ** k above, to which it adds that."""
    state = settled(edges.select("child", F.col("parent").alias("up"), F.lit(1).cast("long").alias("size")))
    for _ in range(rounds_for(edges)):
        active = state.where("up IS NOT NULL")
        if active.isEmpty():
            break
        more = active.groupBy(F.col("up").alias("child")).agg(F.sum("size").alias("more"))
        far = state.select(F.col("child").alias("up"), F.col("up").alias("next"))
        jumped = active.join(far, "up", "left").select("child", F.col("next").alias("up"), "size").unionByName(state.where("up IS NULL"))
        last, state = state, settled(jumped.join(more, "child", "left").select("child", "up", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
        unsettled(last)
    return state.select("child", "size")


def running(df: DataFrame, keys: list[str | Column], value: Column, name: str) -> DataFrame:
    """df with the sum of value over all rows before this one in the order of keys: within range partitions, then before them."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = settled(df.withColumn("_v", value).repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()))
    within = F.sum("_v").over(Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_v")
    each = laid.groupBy("_part").agg(F.sum("_v").alias("_n"))  # a row for each partition
    before = each.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return laid.withColumn(name, within).join(F.broadcast(before), "_part").select(*df.columns, (F.col(name) + F.col("_before")).alias(name))


def preorder(edges: DataFrame, order: list[str]) -> DataFrame:
    """(child, root, place): places from 0 of the walk that visits a node, then its children's trees, siblings and roots in the order of `order`.

    A node's place is its parent's, one more, and the sizes of its earlier siblings' trees; so a sum over its ancestors. edges must hold no cycle."""
    n = sizes(edges)
    sized = edges.select("child", "parent", *order).join(n, "child")
    laid = settled(running(sized, ["parent", *order, "child"], F.col("size"), "at"))
    first = laid.groupBy("parent").agg(F.min("at").alias("first"))
    here = laid.join(first.withColumnRenamed("parent", "_p"), F.col("parent").eqNullSafe(F.col("_p"))).select("child", "parent", (F.col("at") - F.col("first") + F.col("parent").isNotNull().cast("int")).alias("own"))
    here = settled(here)
    unsettled(laid)
    above = climb(here, {"sum": (F.col("own"), "sum")})
    return here.join(above, "child", "left").select("child", F.coalesce("root", "child").alias("root"), (F.col("own") + F.coalesce("sum", F.lit(0))).alias("place"))


def walk(nodes: DataFrame, body: Column, collection: Column) -> DataFrame:
    """(child, place, reached): the nodes that the body reaches in pre-order, siblings by id, then all others by collection and id.

    nodes: (child, parent, ...); body: whether a node is the body's root. Nodes of cycles are among the others."""
    n = nodes.select("child", "parent", body.alias("body"), collection.alias("collection"))
    tops = n.where("body").select("child").withColumnRenamed("child", "top")
    found = climb(n.select("child", F.when(~F.col("body"), F.col("parent")).alias("parent")), {})
    ids = settled(found.join(tops, F.col("root") == F.col("top"), "left_semi").select("child").unionByName(n.where("body").select("child")))
    inside = n.join(ids, "child", "left_semi").select("child", F.when(~F.col("body"), F.col("parent")).alias("parent"))
    reached = preorder(inside, []).select("child", "place", F.lit(True).alias("reached"))
    total = ids.count()
    rest = running(n.join(ids, "child", "left_anti").select("child", "collection"), ["collection", "child"], F.lit(1).cast("long"), "place")
    return reached.unionByName(rest.select("child", (F.col("place") + total).alias("place"), F.lit(False).alias("reached")))


TREE = """WITH RECURSIVE {views}, up(child, up, d) AS (SELECT child, parent, 1 FROM v_edges WHERE parent IS NOT NULL UNION ALL SELECT u.child, e.parent, d + 1 FROM up u JOIN v_edges e ON e.child = u.up WHERE e.parent IS NOT NULL)
"""


def tree_sql(body: str) -> str:
    return TREE.format(views=f"v_edges AS ({V.SQL['v_edges']})") + body


@query(tree_sql("SELECT child FROM v_edges WHERE child % 11 <> 3 AND child NOT IN (SELECT child FROM up WHERE up % 11 = 3)"))
def tree_prune(spark, sf_dir):
    """Nodes left when some go with all below them."""
    e = V.edges(spark, sf_dir)
    gone = climb(e, {"gone": (F.col("child") % 11 == 3, "any")}).where("gone").select("child")
    return e.where("child % 11 <> 3").join(gone, "child", "left_anti").select("child")


@query(tree_sql("SELECT child, count(*) FILTER (WHERE l.label = 'list') AS level, arg_min(up.up % 6 = 3, d) FILTER (WHERE l.label = 'list') AS ordered FROM up JOIN (SELECT child AS id, label FROM v_edges) l ON l.id = up.up GROUP BY 1"))
def list_level(spark, sf_dir):
    """How many lists a node lies in, and whether the nearest of them is an ordered one; null outside of lists."""
    listed = F.col("label") == "list"
    found = climb(V.edges(spark, sf_dir), {"level": (listed.cast("long"), "sum"), "ordered": (F.when(listed, F.col("child") % 6 == 3), "nearest")})
    return found.select("child", "level", "ordered")


@query(tree_sql("SELECT DISTINCT up.child FROM up JOIN v_edges p ON p.child = up.up AND p.label = 'picture' JOIN v_edges t ON t.child = up.child AND t.label = 'text'"))
def picture_descendants(spark, sf_dir):
    """Texts under a picture at any depth. A caption has a label of its own, so that it is none of them."""
    e = V.edges(spark, sf_dir)
    under = climb(e, {"pictured": (F.col("label") == "picture", "any")}).where("pictured").select("child")
    return e.where("label = 'text'").join(under, "child", "left_semi").select("child")


COLLECTION = "CASE label WHEN 'text' THEN 0 WHEN 'picture' THEN 1 ELSE 2 END"
_LOOSE = V.SQL["v_edges"].replace("SELECT o_orderkey AS child, CASE WHEN o_orderkey > 1", "SELECT o_orderkey AS child, CASE WHEN o_orderkey > 1 AND o_orderkey % 97 <> 5")


@query(f"""WITH RECURSIVE n AS ({_LOOSE}), w(child, path) AS (SELECT child, [child] FROM n WHERE child = 1 UNION ALL SELECT n.child, list_append(path, n.child) FROM w JOIN n ON n.parent = w.child)
SELECT child, row_number() OVER (ORDER BY path) - 1 AS place, true AS reached FROM w UNION ALL
SELECT child, (SELECT count(*) FROM w) + row_number() OVER (ORDER BY {COLLECTION}, child) - 1, false FROM n WHERE child NOT IN (SELECT child FROM w)""")
def load_order(spark, sf_dir):
    """The order in which nodes are loaded: those that the body (node 1) reaches as a walk meets them, then what is left, by collection.

    Some nodes have lost their parent, so their trees are left over."""
    e = V.edges(spark, sf_dir).withColumn("parent", F.when(F.col("child") % 97 != 5, F.col("parent")))
    return walk(e, F.col("child") == 1, F.expr(COLLECTION))
