"""Variables by pattern, recursion in the engine, counters, rules as aggregates, bounded histograms."""

import random
import re

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from test_routes import reqs

from routeloom.operators import inference, lookup, pattern_join, routes, tree
from routeloom.operators.routes import NODE
from routeloom.sources import requests as src


@pytest.mark.parametrize(
    ("pattern", "text"),
    [("user_[0-9]+", "user_"), (r"a\.b-[0-9]+", "a.b-"), ("[0-9]+_user", "_user"), ("[0-9]+", ""), ("", ""), ("abc|d[0-9]+", ""), ("abc*[0-9]", ""), (r"\d{4}-\d{2}", ""), ("^exact$", "exact"), ("(?:x)?abc", ""), (r"v[0-9]+", "v"), ("ab{2}", "")],
)
def test_literals(spark, pattern, text):
    assert spark.range(1).select(pattern_join.literal(F.lit(pattern)).alias("x")).first()["x"] == text


def test_pattern_join_against_all_patterns(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abc_.-") for _ in range(rng.randint(1, 6)))
    variables = [(p, f"v{i}", rng.choice([re.escape(word()) + "[0-9]+", "[0-9]+" + re.escape(word()), "[0-9]+", None, "", r"[a-z]+\.[a-z]+"]), rng.randint(0, 9)) for i in range(60) for p in [rng.choice(["/a", "/b", "/c"])]]
    variables += [("/one", "only", "x[0-9]+", 0), ("/e", "any", None, 0), (None, "none", "[0-9]+", 0)]
    segments = [(rng.choice(["/a", "/b", "/c", "/one", "/e", "/none"]), rng.choice([word() + str(rng.randint(0, 99)), str(rng.randint(0, 99)) + word(), "x1", "a.JSON", word()])) for _ in range(600)]
    segments += [(None, "1"), ("/a", None), ("/a", ""), ("/e", "/")]
    got = pattern_join.match(spark.createDataFrame(segments, "parent string, segment string").withColumn("order", F.lit("x")), spark.createDataFrame(variables, "parent string, variable string, pattern string, first_seq long"))
    want = set()
    static = re.compile(r"\.json$", re.I)
    for parent, segment in set(segments):
        if not segment or segment == "/" or parent is None:
            continue
        mine = [v for v in variables if v[0] == parent and (re.search(v[2], segment) if v[2] else not static.search(segment))]
        if mine:
            best = min(mine, key=lambda v: (not v[2], v[3], v[1], v[2] or ""))
            want.add((parent, segment, best[1], best[2] or ""))
    assert {tuple(r) for r in got.collect()} == want and len(want) > 200


def test_each_variable_takes_its_own(spark):
    """Three dates and three ids under one parent make two variables; without patterns the first takes all."""
    asked = [("GET", f"/d/2024-01-0{i}") for i in (1, 2, 3)] + [("GET", f"/d/{w}") for w in ("about", "login-page", "x@a.co", "y@a.co", "z@a.co")]
    built = routes.build(src.parse(reqs(spark, *asked)))
    made = {r["key"]: r["regex"] for r in built.paths.where("node_type = 'request_path_variable'").collect()}
    assert made == {"d_date": r"\d{4}-\d{2}-\d{2}", "var_d": ""}
    new = src.parse(reqs(spark, ("GET", "/d/2025-02-03"), ("GET", "/d/new@a.co"), ("GET", "/d/about"), ("GET", "/d/pic.png"), ("GET", "/no/1"), ("GET", "://x")))
    by = lambda patterns: [r["route"] for r in lookup.find_routes(new, built, patterns).orderBy("seq").collect()]
    assert by(True) == ["/d/{d_date}", "/d/{var_d}", "/d/about", None, None, None]
    assert by(False) == ["/d/{d_date}", "/d/{d_date}", "/d/about", "/d/{d_date}", None, None]


def test_ancestors_of_deep_and_broken_trees(spark):
    row = lambda i, parent: tuple({"node_id": i, "parent_id": parent, "node_type": "request_path", "key": i}.get(c) for c in NODE)
    schema = ", ".join(f"{c} {'int' if c == 'depth' else 'long' if c in ('requests', 'presence', 'first_seq') else 'boolean' if c == 'required' else 'string'}" for c in NODE)
    chain = [row("", None)] + [row("/x" * i, "/x" * (i - 1)) for i in range(1, 121)] + [row("/lost/a", "/lost")]
    found = tree.ancestors(spark.createDataFrame(chain, schema))
    assert found.count() == 120 * 121 // 2 and found.agg(F.max("distance")).first()[0] == 120
    assert spark.conf.get(tree.ROW_LIMIT) == "1000000"


def test_sketches_of_many_values(spark):
    """Votes are exact and different values near enough, in rows whose size doesn't grow; parts make the whole."""
    big = spark.range(200_000).select(F.lit("id").alias("o"), F.col("id").cast("string").alias("value"), F.lit(1).cast("long").alias("cnt"))
    rows = [("enum", v, n) for v, n in (("red", 40), ("blue", 30), ("green", 30))] + [("mail", f"u{i}@b.co", 2) for i in range(50)] + [("money", f"{i}.25", 1) for i in range(60)] + [("none", None, 4), (None, "x", 3)]
    hist = big.unionByName(spark.createDataFrame(rows, "o string, value string, cnt long"))
    want = {r["o"]: r for r in inference.votes(hist, ["o"]).collect()}
    parts = [inference.sketch(hist.where(F.pmod(F.xxhash64("value"), F.lit(3)) == i).withColumnRenamed("cnt", "n"), ["o"]) for i in range(3)]
    whole = inference.merge_sketches(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["o"])
    for found in (inference.votes_of_sketches(whole, ["o"]), inference.votes_in_bounds(hist, ["o"])):
        got = {r["o"]: r for r in found.collect()}
        assert got.keys() == want.keys() and want["id"]["n_values"] == 200_000
        for k, r in want.items():
            assert (got[k]["physical_type"], got[k]["logical_type"], got[k]["total"]) == (r["physical_type"], r["logical_type"], r["total"]), k
            assert abs(got[k]["n_values"] - r["n_values"]) <= 0.05 * r["n_values"]
    size = {r["o"]: r["s"] for r in whole.select("o", (F.length("values") + F.length("v_uuid")).alias("s")).collect()}
    assert size["id"] < 10_000


def test_a_users_rule_as_an_aggregate(spark):
    """A rule of one's own decides on parameters and variables: here the share of even numbers."""

    def add(state, values, counts):
        even, total = state or (0, 0)
        number = values.str.isdigit() & values.str[-1:].isin(list("02468"))
        return even + int(counts[number].sum()), total + int(counts.sum())

    even = inference.aggregate_rule(add, lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: "even" if s[0] == s[1] else None)
    chain = inference.RuleChain(inference.physical_rule, even)
    built = routes.build(src.parse(reqs(spark, *[("GET", f"/u/{2 * i}?n={i}&m=4") for i in range(6)])), infer=chain)
    typed = {r["key"]: (r["physical_type"], r["logical_type"]) for r in routes.nodes(built).where("node_type in ('request_param', 'request_path_variable')").collect()}
    assert typed == {"u_id": ("integer", "even"), "n": ("integer", "string"), "m": ("integer", "even")}
    hist = spark.createDataFrame([("a", "2", 1), (None, "4", 2), ("b", None, 1)], "o string, value string, cnt long")
    assert {r["o"]: r["type"] for r in inference.RuleChain(even).infer(hist, ["o"]).collect()}["a"] == "even"
    assert even(hist.where("false"), ["o"]).count() == 0 and inference.RuleChain().infer(hist, ["o"]).count() == 3


def test_counters_of_one_pass(spark):
    asked = [("GET", f"/n/{i}?a={i}") for i in range(5)] + [("POST", "/b", "application/json", '{"x":1,"y":2}'), ("GET", "://x"), ("GET", "/a?x=%zz"), ("POST", "/b", "application/json", "{"), ("GET", None)]
    parsed = src.parse(reqs(spark, *asked))
    seen = Observation("run")
    built = routes.build(parsed, observation=seen)
    assert seen.get == {"requests_processed": 6, "body_params_parsed": 2, "warnings": 2, "errors": 2}
    assert routes.snapshot(seen, built).collect() == routes.snapshot(parsed, built).collect()
