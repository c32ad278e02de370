"""The route tree as tables: canonical routes, and what was observed under each.

Paths are pre-aggregated to distinct ones.  One aggregation finds the children of all prefixes at once, down to the first level where a parent has enough
children for a variable; there segments are merged, which takes one join, and what is below goes on from the merged prefixes.  So the steps follow the
levels with variables, not the depth.  What hangs below a route are plain aggregates of exploded requests.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from routeloom.functions import requests as R
from routeloom.functions.patterns import ROUTING_HEADERS
from routeloom.operators.inference import Infer, histogram, votes
from routeloom.operators.merge import MergeConfig, Rule, evaluate, replay, with_patterns
from routeloom.sources.store import materialize


@dataclass
class RouteTree:
    """requests: parsed rows with route and n (requests that are alike).  paths: one row for each path node (route, parent, depth,
    node_type, key, regex, requests, first_seq, steps, shape).  variable_values: (route, value, cnt).

    steps are the names on the way from the root, with variables in braces; shape has a 1 for each variable among them and a 0 for each other step.
    """

    requests: DataFrame
    paths: DataFrame
    variable_values: DataFrame
    config: MergeConfig
    infer: Infer = votes


#: What requests may differ in besides their place in the order.
ALIKE = ["method", "keys", "params", "content_type", "media_type", *ROUTING_HEADERS.values(), "cookie"]


def weighted(parsed: DataFrame) -> DataFrame:
    """The rows that parse, with n (1 where missing) and last_seq, as all below takes them."""
    good = parsed.where("error is null") if "error" in parsed.columns else parsed
    more = {"n": F.lit(1).cast("long"), "last_seq": F.col("seq")}
    return good.withColumns({k: v for k, v in more.items() if k not in parsed.columns})


#: Of these the ends of paths are made, and nothing below methods.
OUTLINE = ["method", "keys"]


def compact(parsed: DataFrame, alike: list[str] = ALIKE) -> DataFrame:
    """Requests that are alike in all but their place as one row: seq is the first one's, last_seq the last one's, n their number.

    With fewer columns in ``alike`` (``OUTLINE`` at least) the others are gone, and a tree has no nodes for them.
    """
    # Bad rows are left out by the sums: a filter would be moved below the parser, which then ran twice.
    good = F.col("error").isNull() if "error" in parsed.columns else F.lit(True)
    n = F.col("n") if "n" in parsed.columns else F.lit(1).cast("long")
    last = F.col("last_seq" if "last_seq" in parsed.columns else "seq")
    sums = parsed.groupBy(*alike).agg(F.sum(F.when(good, n)).alias("n"), F.min(F.when(good, F.col("seq"))).alias("seq"), F.max(F.when(good, last)).alias("last_seq"))
    return sums.where("n is not null")


def path_keys(parsed: DataFrame) -> DataFrame:
    """Distinct paths (keys, n, first_seq) of the rows that parse."""
    return weighted(parsed).groupBy("keys").agg(F.sum("n").alias("n"), F.min("seq").alias("first_seq"))


#: So many siblings at least become a variable, whatever the configuration.
LEAST_MERGED = 3


def route_of(steps: Column) -> Column:
    return F.when(F.size(steps) == 0, "").otherwise(F.concat(F.lit("/"), F.array_join(steps, "/")))


def _went(base: int, to: Column) -> dict[str, Column]:
    """steps and shape of paths at depth ``to``, where those at depth ``base`` are known and no variable is between."""
    more = F.slice("keys", F.lit(base + 1), F.greatest(to - base, F.lit(0)))
    return {"steps": F.concat("steps", more), "shape": F.concat("shape", F.repeat(F.lit("0"), F.size(more)))}


def _children(now: DataFrame, base: int) -> DataFrame:
    """(steps, shape, parent, segment, depth, first_seq, n): the children of all prefixes below ``base``, as if none became a variable."""
    keys = F.slice("keys", F.lit(base + 1), F.size("keys") - base)
    rest = now.where(F.size("keys") > base).groupBy("steps", "shape", keys.alias("rest")).agg(F.sum("n").alias("n"), F.min("first_seq").alias("first_seq"))
    each = rest.select("*", F.posexplode("rest").alias("at", "segment"))
    before = F.slice("rest", F.lit(1), F.col("at"))
    each = each.select(F.concat("steps", before).alias("steps"), F.concat("shape", F.repeat(F.lit("0"), F.col("at"))).alias("shape"), "segment", (F.col("at") + base + 1).alias("depth"), "first_seq", "n")
    found = each.groupBy("steps", "segment", "depth").agg(F.min("shape").alias("shape"), F.min("first_seq").alias("first_seq"), F.sum("n").alias("n"))
    return found.withColumn("parent", route_of(F.col("steps")))


def _path_nodes(found: DataFrame) -> DataFrame:
    """Nodes of segments that have been merged: (route, parent, key, is_variable, regex, first_seq, depth, steps, shape, segment, n)."""
    shown = F.coalesce(F.concat(F.lit("{"), "variable", F.lit("}")), "segment")
    is_variable = F.col("variable").isNotNull()
    return found.select(
        F.concat("parent", F.lit("/"), shown).alias("route"), "parent", F.coalesce("variable", "segment").alias("key"), is_variable.alias("is_variable"), "regex", "first_seq", "depth",
        F.concat("steps", F.array(shown)).alias("steps"), F.concat("shape", F.when(is_variable, "1").otherwise("0")).alias("shape"), "segment", "n",
    )


def build(
    parsed: DataFrame, config: MergeConfig = MergeConfig(), evaluator: str = "replay", rule: Rule | None = None, infer: Infer = votes, tree: RouteTree | None = None, observation: Observation | None = None,
) -> RouteTree:
    """Routes of parsed requests.

    evaluator: replay (in order of seq) or set (whole sibling sets at once).  rule: a custom merge rule.  infer: gives the types of
    histograms.  tree: an earlier tree to go on from, as if its requests had come together with the new ones (whose seq should be larger).
    observation: gets the counts of requests while the rows are written, for ``snapshot``.
    Rows with an error are left out; no rows at all give a tree with a root only.
    """
    if observation is not None:
        parsed = parsed.observe(observation, *request_counts())
    if evaluator not in ("replay", "set"):
        raise ValueError(f"no evaluator {evaluator!r}")
    alike = [c for c in ALIKE if c in parsed.columns]
    # Parsing costs more than writing, so it is done once, and the rows are filtered after it: the filter would else parse as well.
    rows = weighted(materialize(parsed.select(*[c for c in ("seq", "last_seq", "n", "error") if c in parsed.columns], *alike))).select("seq", "last_seq", "n", *alike)
    if tree is not None:
        rows = rows.unionByName(tree.requests.select("seq", "last_seq", "n", *alike))
    now = materialize(path_keys(rows)).withColumns({"steps": F.array().cast("array<string>"), "shape": F.lit("")})
    nodes, base = [], 0
    none = F.lit(None).cast("string")
    while True:
        below = materialize(_children(now, base))
        crowded = below.groupBy("parent", "depth").count().where(F.col("count") >= max(config.sibling_merge_threshold, LEAST_MERGED))
        to = crowded.agg(F.min("depth")).first()[0]
        # Down to there no parent has enough children for a variable, so all segments stay.
        fixed = below if to is None else below.where(F.col("depth") < to)
        nodes.append(_path_nodes(fixed.withColumns({"variable": none, "regex": none})))
        if to is None:
            now = now.withColumns(_went(base, F.size("keys")))
            break
        siblings = with_patterns(below.where(F.col("depth") == to))
        choice = replay(siblings, config, rule) if evaluator == "replay" else evaluate(siblings, config, rule)
        found = materialize(_path_nodes(siblings.drop("mask").join(choice, ["parent", "segment"])))
        nodes.append(found)
        step = found.select(F.col("parent").alias("p_"), F.col("segment").alias("s_"), F.element_at("steps", -1).alias("step_"), F.right("shape", F.lit(1)).alias("mark_"))
        there = now.withColumns(_went(base, F.lit(to - 1))).withColumns({"at_": route_of(F.col("steps")), "here_": F.try_element_at("keys", F.lit(to))})
        joined = there.join(step, (F.col("at_") == F.col("p_")) & (F.col("here_") == F.col("s_")), "left")
        known = F.col("step_").isNotNull()
        now = materialize(joined.select(
            "keys", "n", "first_seq", F.when(known, F.concat("steps", F.array("step_"))).otherwise(F.col("steps")).alias("steps"), F.when(known, F.concat("shape", "mark_")).otherwise(F.col("shape")).alias("shape"),
        ))
        base = to
    now = now.withColumn("route", route_of(F.col("steps")))
    named = nodes[0]
    for more in nodes[1:]:
        named = named.unionByName(more)
    same = ["route", "parent", "key", "is_variable", "depth"]
    paths = named.groupBy(*same).agg(F.max("regex").alias("regex"), F.min("first_seq").alias("first_seq"), F.min("steps").alias("steps"), F.min("shape").alias("shape"))
    hist = named.where("is_variable").select("route", F.col("segment").alias("value"), F.col("n").alias("cnt"))
    ends = now.groupBy("route").agg(F.sum("n").alias("requests"))
    kind = F.when(F.col("is_variable"), "request_path_variable").otherwise("request_path")
    paths = paths.join(ends, "route", "left").select("route", "parent", "depth", kind.alias("node_type"), "key", "regex", F.coalesce("requests", F.lit(0)).cast("long").alias("requests"), "first_seq", "steps", "shape")
    return RouteTree(materialize(_placed(rows, now)), materialize(paths), hist, config, infer)


#: A path with so large a share of the requests (one of so many parts) is looked up in a small table, so that its rows don't meet in one task.
FREQUENT = 10_000


def _placed(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """The rows with the route of their path; of the frequent paths there are ``FREQUENT`` at most."""
    total = paths.agg(F.sum("n")).first()[0] or 0
    frequent = F.col("n") * FREQUENT >= total
    of = lambda kept: paths.where(kept).select(F.col("keys").alias("k_"), "route")
    same = F.col("keys") == F.col("k_")
    often, seldom = F.broadcast(of(frequent)), of(~frequent)
    return rows.join(often, same).drop("k_").unionByName(rows.join(often, same, "left_anti").join(seldom, same).drop("k_"))


METHOD = ["route", "method"]


def methods(requests: DataFrame) -> DataFrame:
    return requests.groupBy(*METHOD).agg(F.sum("n").alias("requests"), F.min("seq").alias("first_seq"))


def param_rows(requests: DataFrame) -> DataFrame:
    return requests.select(*METHOD, "seq", "last_seq", "n", F.posexplode("params").alias("pos", "p")).select(*METHOD, "seq", "last_seq", "n", "pos", "p.*")


def params(requests: DataFrame, config: MergeConfig = MergeConfig(), infer: Infer = votes) -> DataFrame:
    """One row for each parameter of a method: presence, whether it is required, types, first and last value."""
    rows = param_rows(requests)
    keys = [*METHOD, "name"]
    seen = rows.groupBy(*keys).agg(
        F.sum("n").alias("presence"), F.min("seq").alias("first_seq"), F.min_by("value", F.struct("seq", "pos")).alias("value"),
        F.max_by(F.when(F.col("value") != "", F.col("value")), F.when(F.col("value") != "", F.struct("last_seq", "pos"))).alias("last_value"),
        F.max((F.col("source") == "body").cast("int")).cast("boolean").alias("in_body"),
    )
    types = infer(histogram(rows.where("value <> ''"), keys), keys).select(*keys, "physical_type", "logical_type")
    total = methods(requests).select(*METHOD, "requests")
    out = seen.join(total, METHOD).join(types, keys, "left")
    needed = (F.col("requests") > 1) & (F.col("presence") / F.col("requests") >= config.required_param_threshold)
    return out.select(
        *keys, "presence", "requests", needed.alias("required"), F.coalesce("physical_type", F.lit("string")).alias("physical_type"),
        F.coalesce("logical_type", F.lit("string")).alias("logical_type"), "value", "last_value", "in_body", "first_seq",
    )


def content_types(requests: DataFrame) -> DataFrame:
    rows = requests.where(R.takes_body(F.col("method")) & (F.coalesce("content_type", F.lit("")) != ""))
    return rows.groupBy(*METHOD, "content_type").agg(F.sum("n").alias("cnt"), F.max("media_type").alias("media_type"), F.min("seq").alias("first_seq"))


def header_rows(requests: DataFrame) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(name).alias("name"), R.header_value(F.lit(name), F.col(column)).alias("value")) for name, column in ROUTING_HEADERS.items()])
    return requests.select(*METHOD, "seq", "n", F.explode(pairs).alias("h")).select(*METHOD, "seq", "n", "h.*").where("value <> ''")


def cookie_rows(requests: DataFrame) -> DataFrame:
    return requests.select(*METHOD, "seq", "n", F.explode(R.cookies(F.col("cookie"))).alias("c")).select(*METHOD, "seq", "n", "c.*").where("value <> ''")


def value_nodes(rows: DataFrame) -> DataFrame:
    """(route, method, name, value, hits, seen_again): a first sighting makes the node, later ones are observed."""
    return rows.groupBy(*METHOD, "name", "value").agg(F.sum("n").alias("hits"), (F.sum("n") - 1).alias("seen_again"), F.min("seq").alias("first_seq"))


def variable_types(tree: RouteTree) -> DataFrame:
    hist = tree.variable_values.groupBy("route", "value").agg(F.sum("cnt").alias("cnt"))
    return tree.infer(hist, ["route"])


NODE = ["node_id", "parent_id", "depth", "node_type", "key", "value", "requests", "presence", "required", "physical_type", "logical_type", "pattern", "default_value", "first_seq"]


def nodes(tree: RouteTree) -> DataFrame:
    """The canonical node table; ids are readable paths, so they are the same in every run.

    A tree of requests without params (``OUTLINE``) has the root, paths and methods only.
    """
    req = tree.requests
    sep = "\u0001"
    null = lambda kind: F.lit(None).cast(kind)
    root_end = req.where("route = ''").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("requests"), F.min("seq").alias("first_seq"))

    def shaped(df: DataFrame, **cols) -> DataFrame:
        kinds = {"depth": "int", "requests": "long", "presence": "long", "required": "boolean", "first_seq": "long"}
        return df.select(*[cols.get(c, null("string")).cast(kinds.get(c, "string")).alias(c) for c in NODE])

    c, route_id = F.col, F.col("route")
    method_id = F.concat("route", F.lit(sep), "method")
    depth = F.size(F.split("route", "/"))
    types = variable_types(tree).select("route", "physical_type", "logical_type")
    parts = [
        shaped(root_end, node_id=F.lit(""), depth=F.lit(0), node_type=F.lit("root"), key=F.lit("root"), value=F.lit(""), requests=c("requests"), first_seq=F.coalesce("first_seq", F.lit(0))),
        shaped(tree.paths.join(types, "route", "left"), node_id=route_id, parent_id=c("parent"), depth=c("depth"), node_type=c("node_type"), key=c("key"), value=F.lit(""), requests=c("requests"),
               physical_type=c("physical_type"), logical_type=c("logical_type"), pattern=c("regex"), first_seq=c("first_seq")),
        shaped(methods(req), node_id=method_id, parent_id=route_id, depth=depth, node_type=F.lit("request_method"), key=c("method"), value=F.lit(""), requests=c("requests"), first_seq=c("first_seq")),
    ]
    below = "params" in req.columns
    parts += [
        shaped(params(req, tree.config, tree.infer), node_id=F.concat(method_id, F.lit(f"{sep}?"), "name"), parent_id=method_id, depth=depth + 1, node_type=F.lit("request_param"), key=c("name"), value=c("value"),
               presence=c("presence"), required=c("required"), physical_type=c("physical_type"), logical_type=c("logical_type"), default_value=c("last_value"), first_seq=c("first_seq")),
        shaped(content_types(req), node_id=F.concat(method_id, F.lit(f"{sep}#"), "content_type"), parent_id=method_id, depth=depth + 1, node_type=F.lit("request_content_type"), key=c("content_type"), value=F.lit(""),
               first_seq=c("first_seq")),
    ] if below else []
    for kind, rows_of, mark in (("header", header_rows, "h:"), ("cookie", cookie_rows, "c:")) if below else ():
        named = value_nodes(rows_of(req))
        name_id = F.concat(method_id, F.lit(f"{sep}{mark}"), "name")
        parts.append(shaped(named.groupBy(*METHOD, "name").agg(F.min("first_seq").alias("first_seq")), node_id=name_id, parent_id=method_id, depth=depth + 1, node_type=F.lit(f"request_{kind}"), key=c("name"), value=c("name"), first_seq=c("first_seq")))
        parts.append(shaped(named, node_id=F.concat(name_id, F.lit(sep), "value"), parent_id=name_id, depth=depth + 2, node_type=F.lit(f"request_{kind}_value"), key=c("value"), value=c("name"), presence=c("seen_again"), first_seq=c("first_seq")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return materialize(out)  # few rows beside the requests, and read again and again


def stats(node_table: DataFrame) -> DataFrame:
    """Thirteen counts of a tree in one row."""
    kind = lambda k: F.count_if(F.col("node_type") == k)
    parents = node_table.select(F.col("parent_id").alias("node_id")).distinct()
    leaves = node_table.join(parents, "node_id", "left_anti").agg(F.count("*").alias("leaves"))
    names = ("root", "request_path", "request_path_variable", "request_method", "request_param", "request_content_type", "request_header", "request_header_value", "request_cookie", "request_cookie_value")
    sums = node_table.agg(F.count("*").alias("nodes"), *[kind(k).alias(k) for k in names[1:]], F.max("depth").cast("long").alias("max_depth"), F.coalesce(F.sum("requests"), F.lit(0)).alias("requests"))
    return sums.join(leaves.withColumn("one", F.lit(1)), F.lit(1) == F.col("one")).drop("one")


def request_counts() -> list[Column]:
    """Counts over parsed rows, as aggregates: good ones, parameters of bodies, warnings (a bad query or body) and errors."""
    lenient = F.col("error").isin("bad query", "bad body")
    of_body = F.when(F.col("error").isNull(), F.size(F.filter("params", lambda p: p["source"] == "body"))).otherwise(0)
    return [
        F.count_if(F.col("error").isNull()).alias("requests_processed"), F.coalesce(F.sum(of_body), F.lit(0)).cast("long").alias("body_params_parsed"), F.count_if(lenient).alias("warnings"),
        F.count_if(F.col("error").isNotNull() & ~lenient).alias("errors"),
    ]


SNAPSHOT = ("requests_processed", "path_variables_identified", "pattern_detections", "params_created", "type_inferences", "body_params_parsed", "required_params_inferred", "merge_attempts", "merge_skipped", "warnings", "errors")


def snapshot(parsed: DataFrame | Observation, tree: RouteTree) -> DataFrame:
    """Eleven counters of a run in one row.  With the observation of a build, the requests aren't gone through again.

    A merge is attempted, and a pattern looked for, once for each set of siblings of at least the threshold; it is skipped where the set has
    no variable in the end.  Warnings are rows with a bad query or body, errors all other bad rows.
    """
    rows = tree.paths.sparkSession.createDataFrame([parsed.get]) if isinstance(parsed, Observation) else parsed.agg(*request_counts())
    kinds = tree.paths.withColumn("variable_", F.col("node_type") == "request_path_variable")
    merged = tree.variable_values.select("route", "value").distinct().groupBy("route").agg(F.count("*").alias("values_"))
    sets = kinds.join(merged, "route", "left").groupBy("parent").agg(F.sum(F.when(F.col("variable_"), F.coalesce("values_", F.lit(0))).otherwise(1)).alias("size_"), F.count_if("variable_").alias("made_"))
    tried = F.col("size_") >= tree.config.sibling_merge_threshold
    merges = sets.agg(F.count_if(tried).alias("merge_attempts"), F.count_if(tried & (F.col("made_") == 0)).alias("merge_skipped"), F.coalesce(F.sum("made_"), F.lit(0)).alias("path_variables_identified"))
    made = params(tree.requests, tree.config, tree.infer).agg(F.count("*").alias("params_created"), F.count_if("required").alias("required_params_inferred"))
    one = lambda df, key: df.withColumn(key, F.lit(1))
    both = one(rows, "i_").join(one(merges, "j_"), F.col("i_") == F.col("j_")).join(one(made, "l_"), F.col("i_") == F.col("l_"))
    counts = both.withColumn("pattern_detections", F.col("merge_attempts")).withColumn("type_inferences", F.col("params_created") + F.col("path_variables_identified"))
    return counts.select(*[F.col(c).cast("long").alias(c) for c in SNAPSHOT])
