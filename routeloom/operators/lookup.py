"""Questions to a route tree, as joins: which route does a request hit, and does it bring anything new?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.functions import requests as R
from routeloom.operators import pattern_join
from routeloom.operators import routes as rt
from routeloom.operators.routes import RouteTree
from routeloom.sources.store import materialize

#: Trees of up to so many levels are walked by a join a level; their few nodes go to all tasks, so no request is shuffled.
LEVELS = 6


def probe(requests: DataFrame, tree: RouteTree, levels: int = LEVELS, patterns: bool = False) -> DataFrame:
    """The requests with hit: the route of their path, null where a segment is unknown.

    A segment is looked up by its exact name first; else the parent's first variable takes it, whatever its pattern.  With ``patterns`` it is the first variable
    whose pattern fits, if any.  Deeper trees than ``levels`` are asked through an index of prefixes, whose number of joins is the same at any depth.
    """
    depth = tree.paths.agg(F.max("depth")).first()[0] or 0
    if patterns:
        return walk_by_patterns(requests, tree, depth)
    return walk(requests, tree, depth) if depth <= levels else by_prefixes(requests, tree, depth)


def walk(requests: DataFrame, tree: RouteTree, depth: int) -> DataFrame:
    """``probe`` from the root down, with a join for each level."""
    known = tree.paths.select("parent", "key", "route", "node_type", "first_seq")
    exact = known.where("node_type = 'request_path'").select(F.col("parent").alias("p_"), F.col("key").alias("k_"), F.col("route").alias("exact_"))
    first = known.where("node_type = 'request_path_variable'").groupBy("parent").agg(F.min_by("route", "first_seq").alias("var_")).withColumnRenamed("parent", "q_")
    now = requests.withColumn("hit", F.when((F.size("segments") <= depth) & F.col("error").isNull(), ""))
    for d in range(depth):
        there = F.size("segments") > d
        now = now.withColumn("s_", F.when(there, F.try_element_at("segments", F.lit(d + 1))))
        now = now.join(exact, (F.col("hit") == F.col("p_")) & (F.col("s_") == F.col("k_")), "left").join(first, F.col("hit") == F.col("q_"), "left")
        now = now.withColumn("hit", F.when(there, F.coalesce("exact_", "var_")).otherwise(F.col("hit"))).drop("s_", "p_", "k_", "exact_", "q_", "var_")
    return now


def walk_by_patterns(requests: DataFrame, tree: RouteTree, depth: int) -> DataFrame:
    """From the root down, where each of a parent's variables takes the segments that its pattern fits."""
    known = tree.paths.select("parent", "key", "route", "node_type", "regex", "first_seq")
    exact = known.where("node_type = 'request_path'").select(F.col("parent").alias("hit"), F.col("key").alias("s_"), F.col("route").alias("exact_"))
    variables = known.where("node_type = 'request_path_variable'").select("parent", F.col("route").alias("variable"), F.col("regex").alias("pattern"), "first_seq")
    now = requests.withColumn("hit", F.when((F.size("segments") <= depth) & F.col("error").isNull(), ""))
    for d in range(depth):
        there = F.size("segments") > d
        now = materialize(now.withColumn("s_", F.when(there, F.try_element_at("segments", F.lit(d + 1)))).join(exact, ["hit", "s_"], "left"))
        open_ = now.where("exact_ is null and s_ is not null").select(F.col("hit").alias("parent"), F.col("s_").alias("segment"))
        taken = pattern_join.match(open_, variables).select(F.col("parent").alias("hit"), F.col("segment").alias("s_"), F.col("variable").alias("var_"))
        now = now.join(taken, ["hit", "s_"], "left").withColumn("hit", F.when(there, F.coalesce("exact_", "var_")).otherwise(F.col("hit"))).drop("s_", "exact_", "var_")
    return now


def _masked(steps: Column, shape: Column) -> Column:
    """The first steps, as many as the shape has marks, with empty ones (no segment is empty) at the variables' places."""
    return F.transform(F.slice(steps, F.lit(1), F.length(shape)), lambda x, i: F.when(F.substring(shape, i + 1, F.lit(1)) == "1", "").otherwise(x))


def prefix_index(tree: RouteTree) -> DataFrame:
    """(h, shape, prefix, route): the nodes that a walk can reach, by the hash of their shape and of their steps without variables."""
    paths = tree.paths.select("route", "parent", "steps", "shape", "node_type", "first_seq")
    variables = paths.where("node_type = 'request_path_variable'")
    first = variables.groupBy("parent").agg(F.min_by("route", "first_seq").alias("route"))
    # Of several variables under a parent the first takes all, so nothing below the others is ever reached.
    later = variables.join(first, ["parent", "route"], "left_anti").select(F.col("route").alias("above_"))
    above = paths.select("route", F.explode(F.transform(F.sequence(F.lit(1), F.size("steps")), lambda i: rt.route_of(F.slice("steps", F.lit(1), i)))).alias("above_"))
    lost = above.join(later, "above_", "left_semi").select("route").distinct()
    found = paths.join(lost, "route", "left_anti").select("route", "shape", _masked(F.col("steps"), F.col("shape")).alias("prefix"))
    return found.select(F.xxhash64("shape", "prefix").alias("h"), "shape", "prefix", "route")


def by_prefixes(requests: DataFrame, tree: RouteTree, depth: int) -> DataFrame:
    """``probe`` by an index of prefixes.

    Each different path asks for its prefixes in the tree's shapes.  Among the nodes found a walk is the one that takes a step by its name where it can:
    the least in the order of shapes in which 0 is before 1 and a node before what it ends at; it is a hit if it is as long as the path.
    """
    index = materialize(prefix_index(tree))
    shapes = index.agg(F.collect_set("shape").alias("shapes")).scalar()
    asked = requests.where(F.col("error").isNull() & (F.size("segments") <= depth)).select("segments").distinct()
    each = asked.withColumn("shapes_", shapes).select("segments", F.explode("shapes_").alias("shape_")).where(F.length("shape_") <= F.size("segments"))
    each = each.withColumn("h_", F.xxhash64("shape_", _masked(F.col("segments"), F.col("shape_"))))
    # Equal hashes are held against each other.
    same = (F.col("h") == F.col("h_")) & (F.col("shape") == F.col("shape_")) & (F.col("prefix") == _masked(F.col("segments"), F.col("shape_")))
    least = F.min_by(F.struct("route", F.length("shape").alias("long")), F.concat("shape", F.lit("2")))
    found = each.join(index, same).groupBy("segments").agg(least.alias("end_")).withColumnRenamed("segments", "asked_")
    hit = F.when(F.col("error").isNotNull(), None).when(F.size("segments") == 0, "").when(F.col("end_.long") == F.size("segments"), F.col("end_.route"))
    return requests.join(found, F.col("segments") == F.col("asked_"), "left").withColumn("hit", hit).drop("asked_", "end_")


def find_routes(requests: DataFrame, tree: RouteTree, patterns: bool = False) -> DataFrame:
    """(seq, route, method, content_type): route is null if the path or its method is unknown, content_type where that is unknown.

    patterns: as in ``probe``.
    """
    known = rt.methods(tree.requests).select(F.col("route").alias("hit"), "method", F.lit(True).alias("has_"))
    types = rt.content_types(tree.requests).select(F.col("route").alias("hit"), "method", "content_type", F.lit(True).alias("typed_"))
    out = probe(requests, tree, patterns=patterns).join(known, ["hit", "method"], "left").join(types, ["hit", "method", "content_type"], "left")
    return out.select("seq", F.when(F.col("has_"), F.col("hit")).alias("route"), "method", F.when(F.col("typed_"), F.col("content_type")).alias("content_type"))


def needed(requests: DataFrame, tree: RouteTree) -> DataFrame:
    """(seq, need): true unless path, method, parameter names, content type, headers and cookies are all known.

    A row with an error, or a null URL, is needed; an empty tree needs all; rows that share a seq share the answer.
    """
    base = tree.requests
    # The answers are read by all that follows, so they are written once.
    hit = materialize(probe(requests, tree).withColumns({"route": F.col("hit"), "n": F.lit(1), "last_seq": F.col("seq")}))
    methods = rt.methods(base).select("route", "method")
    placed = hit.where("error is null and route is not null")
    unknown = hit.join(methods, ["route", "method"], "left_anti").select("seq")
    dims = [
        (rt.param_rows(placed), rt.param_rows(base), ["route", "method", "name"]),
        (rt.header_rows(placed), rt.header_rows(base), ["route", "method", "name", "value"]),
        (rt.cookie_rows(placed), rt.cookie_rows(base), ["route", "method", "name", "value"]),
        (placed.where(R.takes_body(F.col("method")) & (F.coalesce("content_type", F.lit("")) != "")), rt.content_types(base), ["route", "method", "content_type"]),
    ]
    for rows, known, keys in dims:
        unknown = unknown.unionByName(rows.join(known.select(*keys).distinct(), keys, "left_anti").select("seq"))
    found = unknown.distinct().withColumn("new_", F.lit(True))
    return requests.select("seq").join(found, "seq", "left").select("seq", F.coalesce("new_", F.lit(False)).alias("need"))
