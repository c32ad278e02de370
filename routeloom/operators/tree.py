"""Node tables as trees: search, relatives, traversal, edits and unions, as joins on ``parent_id``.

A node table has the columns NODE of :mod:`routeloom.operators.routes`.  Ids are unique, and a node's id begins with its parent's.
A null id or parent matches nothing but the root's; an empty table gives empty results; further columns are dropped where rows are made.
Walks down the tree take one join for each level, those up are one recursive query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.operators.routes import NODE
from routeloom.sources.store import materialize

ROW_LIMIT = "spark.sql.cteRecursionRowLimit"

# --- order of visits ----------------------------------------------------------------------------------------------------------


def with_places(nodes: DataFrame) -> DataFrame:
    """The nodes with place: (first_seq, node_id, key) of every node from the root down to the node; its order is depth first."""
    step = F.array(F.struct("first_seq", "node_id", "key"))
    level = materialize(nodes.where("parent_id is null").withColumn("place", step))
    found = [level]
    while not level.isEmpty():
        above = level.select(F.col("node_id").alias("above_"), F.col("place").alias("before_"))
        level = materialize(nodes.join(above, F.col("parent_id") == F.col("above_")).withColumn("place", F.concat("before_", step)).drop("above_", "before_"))
        found.append(level)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def depth_first(nodes: DataFrame) -> DataFrame:
    return with_places(nodes).orderBy("place").drop("place")


def level_order(nodes: DataFrame) -> DataFrame:
    """Level by level, each in order of arrival under its parents."""
    return with_places(nodes).orderBy(F.size("place"), "place").drop("place")


def paths(nodes: DataFrame) -> DataFrame:
    """(node_id, path): keys from below the root down to the node, joined by slashes."""
    return with_places(nodes).select("node_id", F.concat(F.lit("/"), F.array_join(F.expr("transform(slice(place, 2, size(place)), x -> x.key)"), "/")).alias("path"))


# --- search and relatives -----------------------------------------------------------------------------------------------------


def find(nodes: DataFrame, condition: Column) -> DataFrame:
    """All nodes that fit."""
    return nodes.where(condition)


def find_first(nodes: DataFrame, condition: Column) -> DataFrame:
    """The first node, depth first, that fits; no row if none does."""
    return with_places(nodes).where(condition).orderBy("place").limit(1).drop("place")


def children(nodes: DataFrame, node_id: str, node_type: str | None = None, key: str | None = None, without: str | None = None) -> DataFrame:
    """Children of a node, of one type or key, or of all types but one."""
    out = nodes.where(F.col("parent_id") == node_id)
    out = out if node_type is None else out.where(F.col("node_type") == node_type)
    out = out if key is None else out.where(F.col("key") == key)
    return out if without is None else out.where(F.col("node_type") != without)


def siblings(nodes: DataFrame, node_id: str, node_type: str | None = None, key: str | None = None) -> DataFrame:
    """The other children of a node's parent, of one type or key."""
    parent = nodes.where(F.col("node_id") == node_id).select(F.col("parent_id").alias("of_"))
    out = nodes.join(parent, F.col("parent_id") == F.col("of_")).drop("of_").where(F.col("node_id") != node_id)
    out = out if node_type is None else out.where(F.col("node_type") == node_type)
    return out if key is None else out.where(F.col("key") == key)


def sibling_counts(nodes: DataFrame) -> DataFrame:
    """(node_id, siblings) of all nodes."""
    below = nodes.where("parent_id is not null").groupBy(F.col("parent_id").alias("of_")).agg((F.count("*") - 1).alias("siblings"))
    return nodes.join(below, F.col("parent_id") == F.col("of_"), "left").select("node_id", F.coalesce("siblings", F.lit(0)).cast("long").alias("siblings"))


def ancestors(nodes: DataFrame) -> DataFrame:
    """(node_id, ancestor_id, ancestor_type, distance) for all nodes, from the parent (distance 1) to the root: one recursive query.

    A parent that isn't in the table is no ancestor, and ends the walk.
    """
    spark = nodes.sparkSession
    walk = spark.sql(
        """
        WITH RECURSIVE edges AS (SELECT node_id, parent_id, node_type FROM {nodes}),
        up (node_id, ancestor_id, next_id, ancestor_type, distance) MAX RECURSION LEVEL 10000 AS (
          SELECT a.node_id, b.node_id, b.parent_id, b.node_type, 1 FROM edges AS a JOIN edges AS b ON a.parent_id = b.node_id
          UNION ALL
          SELECT up.node_id, b.node_id, b.parent_id, b.node_type, up.distance + 1 FROM up JOIN edges AS b ON up.next_id = b.node_id)
        SELECT node_id, ancestor_id, ancestor_type, distance FROM up
        """,
        nodes=nodes,
    )
    # Spark stops a recursion at a million rows unless told otherwise; a tree has as many as its nodes times their depth.
    before = spark.conf.get(ROW_LIMIT, None)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        return materialize(walk)
    finally:
        spark.conf.unset(ROW_LIMIT) if before is None else spark.conf.set(ROW_LIMIT, before)


def nearest_ancestor(nodes: DataFrame, node_type: str) -> DataFrame:
    """(node_id, ancestor_id): each node's nearest ancestor of a type."""
    return ancestors(nodes).where(F.col("ancestor_type") == node_type).groupBy("node_id").agg(F.min_by("ancestor_id", "distance").alias("ancestor_id"))


def methods(nodes: DataFrame) -> DataFrame:
    return nodes.where("node_type = 'request_method'")


# --- edits --------------------------------------------------------------------------------------------------------------------


def _shaped(nodes: DataFrame) -> DataFrame:
    return nodes.select(*NODE)


def add(nodes: DataFrame, more: DataFrame) -> DataFrame:
    """Nodes with ``more`` of them; one whose id is known already changes nothing."""
    return _shaped(nodes).unionByName(_shaped(more.join(nodes.select("node_id"), "node_id", "left_anti")))


def add_chain(nodes: DataFrame, path: str, node_type: str = "request_path") -> DataFrame:
    """Find or make the nodes of a path of keys, each under the one before it."""
    spark = nodes.sparkSession
    keys = [x for x in path.split("/") if x]
    last = nodes.agg(F.max("first_seq")).first()[0]
    at = -1 if last is None else last
    rows = [tuple({"node_id": "/" + "/".join(keys[: i + 1]), "parent_id": "/" + "/".join(keys[:i]) if i else "", "depth": i + 1, "node_type": node_type, "key": k, "value": "", "requests": 0, "first_seq": at + i + 1}.get(c) for c in NODE) for i, k in enumerate(keys)]
    return add(nodes, spark.createDataFrame(rows, nodes.select(*NODE).schema)) if rows else _shaped(nodes)


def remove(nodes: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the nodes in ``gone`` (node_id) and all that is below them."""
    ids = gone.select(F.col("node_id").alias("gone_")).distinct()
    below = ancestors(nodes).join(ids, F.col("ancestor_id") == F.col("gone_")).select(F.col("node_id").alias("gone_"))
    return nodes.join(ids.unionByName(below).distinct(), F.col("node_id") == F.col("gone_"), "left_anti")


def remove_children(nodes: DataFrame, node_id: str, node_type: str | None = None) -> DataFrame:
    """Without a node's children, all or those of one type."""
    return remove(nodes, children(nodes, node_id, node_type))


def clone(nodes: DataFrame, node_id: str, new_id: str, parent_id: str) -> DataFrame:
    """A copy of a node and all below it, whose ids begin with new_id, under another parent."""
    below = ancestors(nodes).where(F.col("ancestor_id") == node_id).select("node_id")
    top = nodes.where(F.col("node_id") == node_id)
    copied = nodes.join(below, "node_id", "left_semi").unionByName(top)
    named = lambda c: F.concat(F.lit(new_id), F.substring(c, len(node_id) + 1, F.length(c)))
    moved = copied.withColumn("parent_id", F.when(F.col("node_id") == node_id, F.lit(parent_id)).otherwise(named(F.col("parent_id"))))
    return _shaped(moved.withColumn("node_id", named(F.col("node_id"))))


def merge(base: DataFrame, other: DataFrame) -> DataFrame:
    """The union of two trees by node id: requests and presence are sums, what else both know is the first tree's."""
    both = _shaped(base).withColumn("from_", F.lit(0)).unionByName(_shaped(other).withColumn("from_", F.lit(1)))
    summed = {"requests": F.sum("requests"), "presence": F.sum("presence"), "first_seq": F.min("first_seq"), "required": F.min_by("required", "from_")}
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("from_")))
    return both.groupBy("node_id").agg(*[summed.get(c, first(c)).alias(c) for c in NODE if c != "node_id"]).select(*NODE)


def adopt(base: DataFrame, node_id: str, other: DataFrame, other_id: str) -> DataFrame:
    """``base`` with the subtrees of another node's children whose (type, key) the node in base hasn't got; those it has stay as they are."""
    known = children(base, node_id).select("node_type", "key")
    new = children(other, other_id).join(known, ["node_type", "key"], "left_anti").select("node_id")
    below = ancestors(other).join(new.withColumnRenamed("node_id", "top_"), F.col("ancestor_id") == F.col("top_")).select("node_id")
    copied = other.join(new.unionByName(below).distinct(), "node_id", "left_semi")
    named = lambda c: F.concat(F.lit(node_id), F.substring(c, len(other_id) + 1, F.length(c)))
    return add(base, copied.withColumn("node_id", named(F.col("node_id"))).withColumn("parent_id", named(F.col("parent_id"))))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(node_id, side): nodes that one table has and the other has not, by id, type, key and value."""
    same = ["node_id", "node_type", "key", "value"]
    left, right = a.select(*same), b.select(*same)
    only = lambda x, y, side: x.exceptAll(y).select("node_id", F.lit(side).alias("side"))
    return only(left, right, "first").unionByName(only(right, left, "second"))


def equal(a: DataFrame, b: DataFrame) -> bool:
    return differences(a, b).isEmpty()


def visit(nodes: DataFrame, node_id: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The table after ``change`` was applied to a node's children, in parallel like any other transformation."""
    return nodes.where(~F.coalesce(F.col("parent_id") == node_id, F.lit(False))).unionByName(change(children(nodes, node_id)))


# --- single nodes as text -----------------------------------------------------------------------------------------------------

PLAIN = "node_type string, key string, value string"


def serialize() -> Column:
    """A node's type, key and value as JSON."""
    return F.to_json(F.struct("node_type", "key", F.coalesce("value", F.lit("")).alias("value")))


def deserialize(text: Column) -> Column:
    """A struct of type, key and value; null fields where the text isn't such a document."""
    return F.from_json(text, PLAIN)


# --- context: a map of texts that a node or request carries -------------------------------------------------------------------


def context_set(context: Column, key: str, value: Column) -> Column:
    rest = context_remove(context, key)
    return F.map_concat(rest, F.create_map(F.lit(key), value))


def context_get(context: Column, key: str, default: str | None = None) -> Column:
    return F.coalesce(F.try_element_at(context, F.lit(key)), F.lit(default).cast("string"))


def context_has(context: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(context, F.lit(key)), F.lit(False))


def context_remove(context: Column, key: str) -> Column:
    return F.map_filter(F.coalesce(context, F.create_map().cast("map<string,string>")), lambda k, _: k != F.lit(key))


def context_merge(first: Column, second: Column) -> Column:
    """Both maps; what both have is the second's."""
    none = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(first, none), F.coalesce(second, none)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)
