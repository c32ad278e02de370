"""A route tree that is kept up to date batch by batch, from state by parent.

Each parent's state is what the replay of its segments has come to: its fixed children, merged segments and variables (what a variable
absorbs later changes nothing, and isn't kept).  A batch feeds its new segments to the states of their parents, level by level, and no earlier request
is read: paths that are known only add to their counts.  When earlier children of a parent become a variable, the paths below them move under it, and
only what is below that variable is folded anew, from its different paths.  Rows that come late, before the last path of an earlier batch, cost a new
fold of all different paths.  So after any split of the requests into batches the tree is that of one replay.

A state that moves from key to key as its parents merge can't live in one keyed operator of a stream, whose keys never see each other; so the states are a table of
their own, joined to each micro-batch.  Facts (different requests with counts), paths and states are logs of runs (``Runs``).
"""

from __future__ import annotations

import pickle

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from routeloom.functions.requests import variable_matches
from routeloom.operators.inference import Infer, votes
from routeloom.operators.merge import HEAD, MergeConfig, Rule, Siblings, name_of
from routeloom.operators.routes import ALIKE, RouteTree, compact, path_keys, route_of
from routeloom.sources.requests import parse
from routeloom.sources.store import materialize
from routeloom.streaming.runs import FAN, Runs

PATHS = "keys array<string>, n long, first_seq long, steps array<string>, shape string, ver long"
STATE = "parent string, blob binary, kept array<string>, variables array<struct<name:string,regex:string>>, ver long"
FED = "parent string, segment string, variable string, older boolean, blob binary, kept array<string>, variables array<struct<name:string,regex:string>>"


def _merged_paths(rows: DataFrame) -> DataFrame:
    placed = F.max_by(F.struct("steps", "shape"), F.when(F.col("steps").isNotNull(), F.col("ver"))).alias("p")
    sums = rows.groupBy("keys").agg(F.sum("n").alias("n"), F.min("first_seq").alias("first_seq"), placed, F.max("ver").alias("ver"))
    return sums.select("keys", "n", "first_seq", "p.steps", "p.shape", "ver")


def _merged_state(rows: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("blob", "kept", "variables"), "ver").alias("s")
    return rows.groupBy("parent").agg(last, F.max("ver").alias("ver")).select("parent", "s.*", "ver")


def _merged_facts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*ALIKE).agg(F.sum("n").alias("n"), F.min("seq").alias("seq"), F.max("last_seq").alias("last_seq"))


def feed(segments: DataFrame, state: DataFrame, config: MergeConfig, rule: Rule | None, head: int = HEAD) -> DataFrame:
    """Feed new segments (parent, segment, first_seq) to the states (parent, blob, kept, variables) of their parents.

    Gives the role of each segment, of earlier ones (older) that have become a variable's, and a row with the new state (null segment).  What a parent's first variable takes
    is decided in parallel; of the others ``head`` of a parent meet in a task at first, and the rest only as far as the variable made by then doesn't take it.
    """
    none = F.lit(None)
    empty = state.where("false").select("parent", "blob", "kept", "variables")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=[c.split(" ")[0] for c in FED.split(", ")])
        parent = left["parent"].iloc[0]
        siblings = pickle.loads(right["blob"].iloc[0]) if len(right) else Siblings(name_of(parent), config)
        siblings.rule = rule
        fixed = set(siblings.fixed)
        order = left.sort_values(["first_seq", "segment"])["segment"]
        for s in order:
            siblings.feed(s)
        out = [(parent, s, siblings.role[s][0] if siblings.role[s] else None, False, None, None, None) for s in order]
        new = set(order)
        out += [(parent, s, siblings.role[s][0], True, None, None, None) for s in fixed - set(siblings.fixed) - new]
        # A segment of this batch that was there before, and has changed its role in it, moves what is below it as well.
        out += [(parent, s, siblings.role[s][0], True, None, None, None) for s in (fixed & new) - set(siblings.fixed)]
        siblings.forget_absorbed()
        siblings.rule = None
        made = [{"name": a, "regex": b} for a, b in siblings.variables]
        out.append((parent, None, None, False, pickle.dumps(siblings), list(siblings.role), made))
        return pd.DataFrame(out, columns=["parent", "segment", "variable", "older", "blob", "kept", "variables"])

    def fed(rows: DataFrame, states: DataFrame) -> DataFrame:
        return rows.groupBy("parent").cogroup(states.groupBy("parent")).applyInPandas(run, FED)

    def taken(rows: DataFrame, states: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What the first variables take at once, and the other rows."""
        first = states.where(F.size("variables") > 0).select("parent", F.col("variables")[0].alias("v_"))
        known = states.select("parent", F.explode("kept").alias("segment"), F.lit(True).alias("kept_"))
        both = rows.join(first, "parent", "left").join(known, ["parent", "segment"], "left")
        takes = F.coalesce(F.col("v_").isNotNull() & F.col("kept_").isNull() & variable_matches(F.col("segment"), F.col("v_.regex")), F.lit(False))
        both = materialize(both.withColumn("takes_", takes))
        absorbed = both.where("takes_").select("parent", "segment", F.col("v_.name").alias("variable"), F.lit(False).alias("older"), none.cast("binary").alias("blob"), none.cast("array<string>").alias("kept"), none.cast("array<struct<name:string,regex:string>>").alias("variables"))
        return absorbed, both.where("not takes_").select("parent", "segment", "first_seq")

    states = state.select("parent", "blob", "kept", "variables")
    absorbed, rest = taken(segments.select("parent", "segment", "first_seq"), states)
    most = rest.groupBy("parent").count().agg(F.max("count")).first()[0] or 0
    if most <= head:
        return materialize(absorbed.unionByName(fed(rest, states)))
    ranked = materialize(rest.withColumn("rank_", F.row_number().over(Window.partitionBy("parent").orderBy("first_seq", "segment"))))
    begun = materialize(fed(ranked.where(F.col("rank_") <= head).drop("rank_"), states))
    now = empty.unionByName(begun.where("segment is null").select("parent", "blob", "kept", "variables"))
    more, left = taken(ranked.where(F.col("rank_") > head).drop("rank_"), now)
    late = materialize(fed(left, now))
    # A state that went on replaces the one it began from, and so do roles that it changed.
    begun = begun.join(late.where("segment is null").select("parent", F.lit(True).alias("on_")), "parent", "left").where("segment is not null or on_ is null").drop("on_")
    begun = begun.join(late.where("older").select("parent", "segment", F.col("variable").alias("w_")), ["parent", "segment"], "left")
    begun = begun.withColumn("variable", F.coalesce("w_", "variable")).drop("w_")
    return materialize(absorbed.unionByName(begun).unionByName(more).unionByName(late))


class Fold:
    """The tree of all batches so far, in a folder.  update(batch, id) takes the next one, or one again; tree() gives the tree."""

    def __init__(self, spark: SparkSession, folder: str, config: MergeConfig = MergeConfig(), rule: Rule | None = None, infer: Infer = votes, fan: int = FAN, head: int = HEAD):
        self.spark, self.config, self.rule, self.infer, self.head = spark, config, rule, infer, head
        kinds = dict(compact(parse(spark.createDataFrame([], "seq long, method string, url string, body string"))).dtypes)
        facts = ", ".join(f"{c} {kinds[c]}" for c in [*ALIKE, "n", "seq", "last_seq"])
        self.facts = Runs(spark, f"{folder}/facts", facts, _merged_facts, fan)
        self.paths = Runs(spark, f"{folder}/paths", PATHS, _merged_paths, fan)
        self.state = Runs(spark, f"{folder}/state", STATE, _merged_state, fan)

    def update(self, parsed: DataFrame, batch: int) -> None:
        """The next batch of parsed requests.  Bad rows are left out; an empty batch changes nothing."""
        if any(first <= batch <= last and first < last for first, last in self.facts.runs()):
            return  # a merged run holds finished batches only
        rows = materialize(compact(parsed))
        self.facts.append(rows, batch)
        known = materialize(self.paths.read(batch))
        now = materialize(path_keys(rows).join(known.select("keys", F.col("first_seq").alias("was_")), "keys", "left"))
        fresh = now.where("was_ is null").select("keys", "n", "first_seq")
        last = known.agg(F.max("first_seq")).first()[0]
        late = last is not None and not now.where((F.col("first_seq") < F.coalesce("was_", F.lit(last)))).isEmpty()
        counted = now.where("was_ is not null").select("keys", "n", "first_seq", F.lit(None).cast("array<string>").alias("steps"), F.lit(None).cast("string").alias("shape"))
        start = {"steps": F.array().cast("array<string>"), "shape": F.lit("")}
        work = fresh.withColumns({**start, "again": F.lit(late)})
        states = self.state.read(batch)
        if late:
            # n is 0 for paths whose requests are counted already.
            earliest = known.join(now.select("keys", F.col("first_seq").alias("now_")), "keys", "left").withColumn("first_seq", F.least("first_seq", "now_"))
            work = work.unionByName(earliest.select("keys", F.lit(0).cast("long").alias("n"), "first_seq").withColumns({**start, "again": F.lit(True)}))
            states = states.where("false")
        placed, made = self._place(materialize(work), known, materialize(states))
        columns = ["keys", "n", "first_seq", "steps", "shape"]
        self.paths.append(placed.select(*columns).unionByName(counted.select(*columns)).withColumn("ver", F.lit(batch).cast("long")), batch)
        self.state.append(made.withColumn("ver", F.lit(batch).cast("long")), batch)

    def _place(self, work: DataFrame, known: DataFrame, states: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Paths (keys, n, first_seq, again) with their steps and shape, and the states that have changed."""
        made, d = None, 0
        while d < (work.agg(F.max(F.size("keys"))).first()[0] or 0):
            here = F.try_element_at("keys", F.lit(d + 1))
            there = work.withColumns({"parent": route_of(F.col("steps")), "segment": F.when(F.size("keys") > d, here)})
            segments = there.where("segment is not null").groupBy("parent", "segment").agg(F.min("first_seq").alias("first_seq"), F.max("again").alias("again"))
            anew = segments.where("again").select("parent").distinct()
            found = feed(segments, states.join(anew, "parent", "left_anti").join(segments.select("parent").distinct(), "parent", "left_semi"), self.config, self.rule, self.head)
            blobs = found.where("segment is null").select("parent", "blob", "kept", "variables")
            made = blobs if made is None else made.unionByName(blobs)
            role = found.where("segment is not null and not older").select("parent", "segment", "variable")
            shown = F.when(F.col("variable").isNotNull(), F.concat(F.lit("{"), "variable", F.lit("}"))).otherwise(F.col("segment"))
            moved = materialize(found.where("older").select("parent", "segment", shown.alias("shown_")))
            goes = F.col("segment").isNotNull()
            mark = F.when(F.col("variable").isNotNull(), "1").otherwise("0")
            work = there.join(role, ["parent", "segment"], "left").select(
                "keys", "n", "first_seq", "again", F.when(goes, F.concat("steps", F.array(shown))).otherwise(F.col("steps")).alias("steps"), F.when(goes, F.concat("shape", mark)).otherwise(F.col("shape")).alias("shape"),
            )
            d += 1
            if not moved.isEmpty():
                work = self._with_moved(materialize(work), known, moved, d)
            work = materialize(work)
        none = states.where("false").select("parent", "blob", "kept", "variables")
        return work, none if made is None else none.unionByName(made)

    def _with_moved(self, work: DataFrame, known: DataFrame, moved: DataFrame, d: int) -> DataFrame:
        """The work with earlier paths below segments that became a variable at level d, and below that variable: all of these are folded anew from there."""
        targets = moved.select("parent", "shown_").distinct()
        head = F.slice("steps", 1, d - 1)
        deep = known.where(F.size("steps") >= d).withColumns({"parent": route_of(head), "segment": F.element_at("steps", d)})
        from_ = moved.select("parent", "segment", "shown_")
        under = targets.select("parent", F.col("shown_").alias("segment"), "shown_")
        # A fixed segment may be named like a variable with its braces; its shape tells them apart.
        mark = F.substring("shape", d, 1)
        hit = deep.where(mark == "0").join(from_, ["parent", "segment"]).unionByName(deep.where(mark == "1").join(under, ["parent", "segment"]))
        steps, shape = F.concat(head, F.array("shown_")), F.concat(F.substring("shape", 1, d - 1), F.lit("1"))
        taken = hit.select("keys", F.lit(0).cast("long").alias("n"), "first_seq", F.lit(True).alias("again"), steps.alias("steps"), shape.alias("shape"))
        taken = taken.join(work.select("keys"), "keys", "left_anti")
        here = targets.select(F.col("parent").alias("p_"), F.col("shown_").alias("s_"))
        # New paths below the variable are part of what is folded anew.
        same = (route_of(head) == F.col("p_")) & (F.try_element_at("steps", F.lit(d)) == F.col("s_")) & (F.substring("shape", d, 1) == "1")
        marked = work.join(here, same, "left").withColumn("again", F.col("again") | F.col("p_").isNotNull()).select(*work.columns)
        return marked.unionByName(taken)

    def tree(self, alike: list[str] = ALIKE) -> RouteTree:
        """The tree of all batches: that of one replay of all requests; ``alike`` as in ``compact``."""
        placed, state = materialize(self.paths.read()), self.state.read()
        step = lambda i: F.element_at("steps", i)
        each = placed.select("*", F.explode(F.when(F.size("steps") > 0, F.sequence(F.lit(1), F.size("steps"))).otherwise(F.array().cast("array<int>"))).alias("depth"))
        before: Column = F.slice("steps", F.lit(1), F.col("depth") - 1)
        each = each.withColumns({"parent": route_of(before), "is_variable": F.substring("shape", F.col("depth"), F.lit(1)) == "1", "shown": step(F.col("depth"))})
        key = F.when(F.col("is_variable"), F.substring("shown", F.lit(2), F.length("shown") - 2)).otherwise(F.col("shown"))
        cut = {"route": F.concat("parent", F.lit("/"), "shown"), "key": key, "ends": F.when(F.size("steps") == F.col("depth"), F.col("n")).otherwise(0)}
        each = each.withColumns(cut).withColumns({"steps_": F.slice("steps", F.lit(1), F.col("depth")), "shape_": F.substring("shape", F.lit(1), F.col("depth"))})
        same = ["route", "parent", "key", "is_variable", "depth"]
        paths = each.groupBy(*same).agg(F.min("first_seq").alias("first_seq"), F.min("steps_").alias("steps"), F.min("shape_").alias("shape"), F.sum("ends").cast("long").alias("ends"))
        # A route may also be the whole of a path that has slashes inside its segments; its requests are those of the route.
        requests = placed.groupBy(route_of(F.col("steps")).alias("route")).agg(F.sum("n").alias("requests"))
        regex = state.select("parent", F.explode("variables").alias("v")).groupBy("parent", F.col("v.name").alias("key")).agg(F.max("v.regex").alias("regex"))
        regex = regex.withColumn("is_variable", F.lit(True))
        kind = F.when(F.col("is_variable"), "request_path_variable").otherwise("request_path")
        paths = paths.join(regex, ["parent", "key", "is_variable"], "left").join(requests, "route", "left")
        paths = paths.select("route", "parent", "depth", kind.alias("node_type"), "key", "regex", F.coalesce("requests", F.lit(0)).cast("long").alias("requests"), "first_seq", "steps", "shape")
        values = each.where("is_variable").groupBy("route", F.element_at("keys", F.col("depth")).alias("value")).agg(F.sum("n").alias("cnt"))
        rows = compact(self.facts.rows(), alike)
        rows = rows.join(placed.select(F.col("keys").alias("k_"), route_of(F.col("steps")).alias("route")), F.col("keys") == F.col("k_")).drop("k_")
        return RouteTree(materialize(rows), materialize(paths), materialize(values), self.config, self.infer)


def ingest(requests: DataFrame, fold: Fold, checkpoint: str, **trigger) -> StreamingQuery:
    """Start the query that feeds a stream of requests to a fold, and counts them as it goes (``lastProgress["observedMetrics"]["requests"]``)."""
    from routeloom.streaming.ingest import counted

    def write(batch: DataFrame, batch_id: int) -> None:
        fold.update(batch, batch_id)

    return counted(parse(requests)).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
