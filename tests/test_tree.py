"""Trees from trees, generated requests, headers, extraction, pluggable inference and merging, streams, logs; unusual input."""

import logging

import pytest
from pyspark.sql import functions as F
from test_routes import SCHEMA, reqs

import __spark_entry__
from routeloom.functions import requests as R
from routeloom.functions.json import json_params, number_text
from routeloom.functions.patterns import ROUTING_HEADERS
from routeloom.operators import inference, lookup, merge, routes, tree
from routeloom.operators.merge import DEFAULT, MERGE, SKIP, MergeConfig
from routeloom.plans import catalog
from routeloom.sources import log, synthetic
from routeloom.sources import requests as src
from routeloom.sources.curl import from_curls
from routeloom.streaming import ingest

SF = "/root/testdata/sf0.001"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


@pytest.fixture(scope="module")
def nodes(spark):
    asked = [("GET", f"/api/users/{i}?page=1&size={i}") for i in (11, 12, 13)] + [("POST", "/api/users", "application/json", '{"name":"a"}'), ("GET", "/api/health"), ("GET", "/")]
    return routes.nodes(routes.build(src.parse(reqs(spark, *asked))))


def test_search_and_relatives(nodes):
    assert rows(tree.children(nodes, "/api"), "key") == [("health",), ("users",)]
    assert rows(tree.children(nodes, "/api", key="health"), "node_id") == [("/api/health",)]
    assert rows(tree.children(nodes, "/api/users", without="request_method"), "key") == [("users_id",)]
    assert rows(tree.children(nodes, "/api/users", node_type="request_method"), "key") == [("POST",)]
    assert rows(tree.siblings(nodes, "/api/users"), "key") == [("health",)]
    assert rows(tree.siblings(nodes, "/api/users", node_type="request_method")) == []
    counts = dict(rows(tree.sibling_counts(nodes)))
    assert counts["/api/users"] == 1 and counts[""] == 0 and counts["/api"] == 1  # the root's own method is its sibling
    up = {(a, b): d for a, b, _, d in rows(tree.ancestors(nodes))}
    assert up[("/api/users/{users_id}", "")] == 3 and up[("/api/users/{users_id}", "/api/users")] == 1 and ("", "") not in up
    near = dict(rows(tree.nearest_ancestor(nodes, "request_method")))
    assert near["/api/users/{users_id}\u0001GET\u0001?page"] == "/api/users/{users_id}\u0001GET" and "/api" not in near
    assert dict(rows(tree.paths(nodes)))["/api/users/{users_id}"] == "/api/users/users_id"
    assert tree.find(nodes, F.col("key") == "page").count() == 1
    assert tree.find_first(nodes, F.col("node_type") == "request_method").first()["key"] == "GET"
    assert tree.find_first(nodes, F.lit(False)).count() == 0


def test_outline(spark, monkeypatch):
    """Trees of alike requests that are counted while parsed, bad rows left out, have the same paths and methods; so have those whose paths are all frequent, or none is."""
    asked = [("GET", f"/api/users/{i}?page={i}") for i in range(11, 31)] + [("POST", "/api/users", "application/json", '{"name":"a"}')] * 9 + [("POST", "/api/users", "application/json", "{"), ("GET", "/a/%zz"), ("GET", "/")]
    parsed = src.parse(reqs(spark, *asked))
    assert {(r["method"], "/".join(r["keys"]), r["n"]) for r in routes.compact(parsed, routes.OUTLINE).where("method = 'POST' or size(keys) = 0").collect()} == {("POST", "api/users", 9), ("GET", "", 1)}
    columns = ("node_id", "parent_id", "node_type", "key", "requests", "pattern", "physical_type", "first_seq")
    shown = lambda tree, kinds: sorted(map(str, rows(routes.nodes(tree).where(F.col("node_type").isin(*kinds)).fillna(""), *columns)))
    kinds = ("root", "request_path", "request_path_variable", "request_method")
    want = shown(routes.build(parsed), kinds)
    assert len(want) == 7
    for parts, evaluator in ((0, "replay"), (4, "set")):
        monkeypatch.setattr(routes, "FREQUENT", parts)
        outline = routes.nodes(routes.build(routes.compact(parsed, routes.OUTLINE), evaluator=evaluator))
        assert sorted(map(str, rows(outline.fillna(""), *columns))) == want and outline.where(~F.col("node_type").isin(*kinds)).count() == 0


def test_orders_of_visits(nodes):
    deep = [r["node_id"] for r in tree.depth_first(nodes).collect()]
    assert deep[0] == "" and deep.index("/api/users") < deep.index("/api/users/{users_id}") < deep.index("/api/health") and len(deep) == nodes.count()
    level = [r["depth"] for r in tree.level_order(nodes).collect()]
    assert level == sorted(level)


def test_edits_and_unions(spark, nodes):
    longer = tree.add_chain(nodes, "/api/users/new/one")
    assert longer.count() == nodes.count() + 2 and tree.add_chain(longer, "api/users/new/one").count() == longer.count()
    assert tree.add_chain(nodes, "").count() == nodes.count()
    assert not tree.find(tree.remove(longer, longer.where("node_id = '/api/users/new'")), F.col("key").isin("new", "one")).count()
    assert tree.remove_children(nodes, "/api").where("node_id like '/api/%'").count() == 0
    below = nodes.where("node_id like '/api/users%'").count()
    copy = tree.clone(nodes, "/api/users", "/v2/people", "/v2")
    assert copy.count() == below and copy.where("node_id = '/v2/people/{users_id}'").first()["parent_id"] == "/v2/people"
    both = tree.merge(nodes, nodes)
    assert tree.equal(both, nodes) and both.agg(F.sum("requests")).first()[0] == 2 * nodes.agg(F.sum("requests")).first()[0]
    assert rows(tree.differences(nodes, tree.add_chain(nodes, "/x"))) == [("/x", "second")]
    other = tree.add_chain(tree.add_chain(nodes.where("false"), "/q/health/deep"), "/q/extra/deep")
    taken = tree.adopt(nodes, "/api", other, "/q")
    assert rows(taken.where("node_id like '/api/extra%'"), "node_id") == [("/api/extra",), ("/api/extra/deep",)] and not taken.where("node_id = '/api/health/deep'").count()
    seen = tree.visit(nodes, "/api", lambda kids: kids.withColumn("value", F.lit("seen")))
    assert seen.where("value = 'seen'").count() == 2 and seen.count() == nodes.count()
    assert tree.methods(nodes).count() == 4


def test_empty_node_tables(nodes):
    none = nodes.where("false")
    for df in (tree.depth_first(none), tree.level_order(none), tree.paths(none), tree.ancestors(none), tree.sibling_counts(none), tree.remove(none, none), tree.merge(none, none), tree.clone(none, "a", "b", "c")):
        assert df.count() == 0
    assert tree.equal(none, none) and tree.merge(none, nodes).count() == nodes.count()


def test_documents_and_context(spark, nodes):
    back = nodes.select("node_type", "key", tree.deserialize(tree.serialize()).alias("x"))
    assert back.where("x.node_type <> node_type or x.key <> key").count() == 0
    assert spark.range(1).select(tree.deserialize(F.lit("{")).alias("x")).first()["x"] in (None, (None, None, None))
    c = F.create_map(F.lit("a"), F.lit("1"))
    none = F.lit(None).cast("map<string,string>")
    got = spark.range(1).select(
        tree.context_set(c, "a", F.lit("2")).alias("set"), tree.context_get(c, "z", "d").alias("get"), tree.context_has(none, "a").alias("has"), tree.context_remove(c, "a").alias("rest"),
        tree.context_merge(c, F.create_map(F.lit("a"), F.lit("3"), F.lit("b"), F.lit("4"))).alias("both"), tree.context_set(none, "k", F.lit("v")).alias("new"),
    ).first()
    assert (got["set"], got["get"], got["has"], got["rest"], got["both"], got["new"]) == ({"a": "2"}, "d", False, {}, {"a": "3", "b": "4"}, {"k": "v"})


def test_extraction(spark):
    def one(q, default="", required=False):
        r = spark.range(1).select(R.extract_param(F.lit(q).cast("string"), F.lit("Tag"), F.lit(default), F.lit(required)).alias("x")).first()["x"]
        return r["found"], r["value"], r["multi"]

    assert one("tag=go&TAG=web&x=1") == (True, "go,web", True) and one("tag=a%20b") == (True, "a%20b", False) and one("tag") == (True, "", False)
    assert one("x=1", "d", True) == (True, "d", False) and one("x=1", "", True) == (False, None, False) and one(None) == (True, "", False)
    take = lambda s, p: spark.range(1).select(R.extract_variable(F.lit(s), F.lit(p).cast("string")).alias("x")).first()["x"]
    assert take("user_7x", "[0-9]+") == "user_7x" and take("word", "[0-9]+") is None and take("a.PNG", None) is None and take("/", None) is None and take("b", None) == "b"
    has = lambda q, n: spark.range(1).select(R.query_has(F.lit(q), F.lit(n)).alias("x")).first()["x"]
    assert has("a=1&Page=2", "page") and has("PAGE", "page") and not has("page_size=1", "page") and not has("xpage=1", "page")


def test_leaves_of_large_keys(spark, tmp_path):
    """Half a key is written out from a million on, as the SQL does; the default has exponents there."""
    duckdb = pytest.importorskip("duckdb")
    part = spark.read.parquet(f"{SF}/part.parquet").limit(1)
    keys = [999_999, 1_000_000, 1_200_007, 123_456_789]
    part.withColumn("p_partkey", F.explode(F.array(*map(F.lit, keys)).cast("array<long>"))).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    want = duckdb.sql(__spark_entry__.oracle_sql()["json_nested_flatten"].replace("FROM part)", f"FROM '{tmp_path}/part.parquet/*.parquet')")).fetchall()
    assert rows(catalog.json_nested_flatten(spark, str(tmp_path)), "seq", "name", "value") == sorted(want) and len(want) == 8 * len(keys)


def test_plain_numbers(spark):
    numbers = [(1234567.5, "1234567.5"), (-1e20, "-100000000000000000000"), (1.5e21, "1500000000000000000000"), (0.00001234, "0.00001234"), (0.25, "0.25"), (-2.5, "-2.5")]
    got = spark.createDataFrame(numbers, "d double, text string").select("text", number_text(F.col("d"), plain=True).alias("x")).collect()
    assert [r["x"] for r in got] == [r["text"] for r in got]


@pytest.mark.parametrize(("number", "text"), [(1234567.5, "1.2345675e+06"), (0.00001234, "1.234e-05"), (0.000123, "0.000123"), (-2.5, "-2.5"), (123456.75, "123456.75"), (1e20, "1e+20"), (1e-100, "1e-100"), (0.1, "0.1")])
def test_numbers(spark, number, text):
    assert spark.createDataFrame([(number,)], "d double").select(number_text(F.col("d")).alias("x")).first()["x"] == text


def test_json_bodies(spark):
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    bodies = ['{"user":{"Name":"bob","address":{"city":"上海"}},"tags":["vip","new"]}', "[1,2]", "3", '{"a":1e3,"b":1.5,"c":null,"d":true,"e":{},"f":[]}', '{"a":1,"a":2}', "{", '{"x":' * 40 + "1" + "}" * 40, '"[{"', None, '{"big":1e25}']
    got = spark.createDataFrame(list(enumerate(bodies)), "i int, b string").select("i", json_params(F.col("b")).alias("p")).orderBy("i").collect()
    found = [None if r["p"] is None else sorted(tuple(x) for x in r["p"]) for r in got]
    assert found == [
        [("tags.0", "vip"), ("tags.1", "new"), ("user.address.city", "上海"), ("user.name", "bob")], [(".0", "1"), (".1", "2")], [], [("a", "1000"), ("b", "1.5"), ("c", ""), ("d", "true")], [("a", "2")], None,
        [(".".join("x" * 40), "1")], [], None, [("big", "1e+25")],
    ]


def test_parse_needs_no_python_and_takes_headers(spark):
    data = spark.createDataFrame([(1, "GET", "/a", None, {"ACCEPT": "text/html;q=1", "x-api-version": "2", "accept-language": "en , de", "X-Requested-With": "XMLHttpRequest", "Other": "x", "cookie": "a=b"})], "seq long, method string, url string, body string, headers map<string,string>")
    parsed = src.parse(data)
    assert "Python" not in parsed._jdf.queryExecution().executedPlan().toString()
    got = rows(routes.header_rows(routes.weighted(parsed.withColumn("route", F.lit("/a")))), "name", "value")
    assert got == [("Accept", "text/html"), ("Accept-Language", "en"), ("X-Api-Version", "2"), ("X-Requested-With", "XMLHttpRequest")]
    assert parsed.first()["cookie"] == "a=b"
    line = "curl http://h/a -H 'X-Api-Version: 3' -H 'accept-language: zh'"
    r = from_curls(spark.createDataFrame([(1, line)], "seq long, line string")).first()
    assert (r["x_api_version"], r["accept_language"], r["x_requested_with"]) == ("3", "zh", None)
    known = routes.build(parsed, evaluator="set")
    changed = src.parse(data.withColumn("headers", F.map_concat(F.map_filter("headers", lambda k, _: k != "x-api-version"), F.create_map(F.lit("x-api-version"), F.lit("9")))))
    assert not lookup.needed(parsed, known).first()["need"] and lookup.needed(changed, known).first()["need"]


def test_resume_equals_one_build(spark):
    asked = [("GET", f"/a/{i}?p={i % 2}") for i in range(2)] + [("GET", "/a/list"), ("POST", "/b", "application/json", '{"k":1}'), ("GET", "/a/7"), ("GET", "/a/8"), ("GET", "/c?q=1")]
    parsed = src.parse(reqs(spark, *asked))
    whole = routes.nodes(routes.build(parsed))
    step = None
    for low, high in ((0, 2), (2, 5), (5, 99)):
        step = routes.build(parsed.where(F.col("seq").between(low, high - 1)), tree=step)
    assert sorted(map(str, routes.nodes(step).collect())) == sorted(map(str, whole.collect()))


def test_stream_in_batches_equals_one_batch(spark, tmp_path):
    asked = [("GET", f"/a/{i % 5}?p={i % 3}", None, None, "text/html", "Bearer x", "s=1") for i in range(24)] + [("POST", "/b", "application/json", '{"k":1}')] * 3 + [("GET", "://bad")]
    data = reqs(spark, *asked)
    data.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest.ingest(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert len(list((tmp_path / "out").glob("batch=*"))) == 3
    built = ingest.tree(spark, str(tmp_path / "out"))
    assert sorted(map(str, routes.nodes(built).collect())) == sorted(map(str, routes.nodes(routes.build(src.parse(data))).collect()))
    more = reqs(spark, ("GET", "/a/999"), ("GET", "/new/x"), ("DELETE", "/b"))
    more.write.parquet(str(tmp_path / "more"))
    ingest.unseen(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "more")), built, str(tmp_path / "unseen"), str(tmp_path / "state2")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "unseen")), "seq") == [(1,), (2,)]


def test_rules_reach_the_set_evaluator(spark):
    sib = spark.createDataFrame([("/p", v, i) for i, v in enumerate(["a1", "list", "b2", "c3", "zz"])], "parent string, segment string, first_seq long")
    got = lambda rule: {r["segment"]: r["variable"] for r in merge.evaluate(sib, MergeConfig(), rule).collect()}
    assert set(got(lambda *a: (SKIP, [])).values()) == {None}
    assert got(lambda n, v, *a: (MERGE, [v[0], v[1], v[4], "unknown"])) == {"a1": "p_code", "list": "p_code", "b2": None, "c3": None, "zz": "p_code"}
    assert got(lambda n, v, *a: (MERGE, v[:2])) == dict.fromkeys(["a1", "list", "b2", "c3", "zz"])
    assert got(lambda n, v, p, share, c: (DEFAULT, [])) == {r["segment"]: r["variable"] for r in merge.evaluate(sib).collect()}
    with pytest.raises(ValueError, match="evaluator"):
        routes.build(src.parse(reqs(spark, ("GET", "/a"))), evaluator="other")


def test_inference_is_pluggable(spark):
    shout = lambda hist, keys: hist.select(*keys).distinct().withColumn("type", F.lit("loud"))
    chain = inference.RuleChain(inference.physical_rule, shout)
    built = routes.build(src.parse(reqs(spark, *[("GET", f"/u/{i}?n={i}") for i in range(4)])), infer=chain)
    typed = {r["node_type"]: (r["physical_type"], r["logical_type"]) for r in routes.nodes(built).collect()}
    assert typed["request_param"] == typed["request_path_variable"] == ("integer", "loud")
    old = spark.createDataFrame([("a", "1", 3), ("b", "x", 1)], "o string, value string, cnt long")
    new = spark.createDataFrame([("a", "1", 9), ("b", "x", 1), ("b", "2024-01-02", 9), ("c", "true", 1)], "o string, value string, cnt long")
    fresh = inference.refresh(inference.votes(old, ["o"]), old, new, ["o"])
    assert {r["o"]: (r["logical_type"], r["total"]) for r in fresh.collect()} == {"a": ("string", 3), "b": ("date", 10), "c": ("string", 1)}
    assert inference.resolve_histogram(None, old, new) is old
    with pytest.raises(ValueError, match="histogram"):
        inference.resolve_histogram(None)


def test_generated_requests(spark):
    spec = synthetic.random_spec(5)
    data = synthetic.requests(spark, spec, 3000, ids=300)
    assert rows(data.limit(50)) == rows(synthetic.requests(spark, spec, 3000, ids=300).limit(50)) and str(spec).startswith("seed 5")
    built = routes.build(src.parse(data), evaluator="set")
    want = synthetic.expected(spec)
    assert {(r["route"], r["method"]) for r in routes.methods(built.requests).collect()} == {(x["route"], x["method"]) for x in want}
    needed = {(r["route"], r["method"], r["name"]) for r in routes.params(built.requests).where("required").collect()}
    assert needed == {(x["route"], x["method"], n) for x in want for n in x["required"]}
    assert synthetic.requests(spark, synthetic.Spec(), 5).count() == 0


def test_logs_and_counters(spark, caplog):
    parsed = src.parse(reqs(spark, ("GET", "/ok?a=1"), ("GET", "://x"), ("GET", "/a?x=%zz"), ("POST", "/a", "application/json", "{"), ("POST", "/a", "application/json", '{"b":1,"c":2}')))
    told = lambda level: rows(log.diagnostics(parsed, level), "seq", "level")
    assert told("error") == [(1, "error")] and told("warn") == [(1, "error"), (2, "warn"), (3, "warn")] and told("off") == [] and len(told("debug")) == 7
    long = src.parse(reqs(spark, ("GET", "://" + "x" * 600)))
    assert len(log.diagnostics(long).first()["value"]) == log.MAX_VALUE + 3
    logger = log.logger("info", "routeloom.test")
    with caplog.at_level(logging.INFO, "routeloom.test"):
        logger.info("value %s", "é" * 400)
    assert caplog.messages[0].endswith("...") and len(caplog.messages[0].encode()) < 530 and not log.logger("off", "routeloom.test").isEnabledFor(logging.ERROR)
    built = routes.build(parsed)
    got = routes.snapshot(parsed, built).first().asDict()
    assert (got["requests_processed"], got["warnings"], got["errors"], got["body_params_parsed"], got["params_created"], got["merge_attempts"]) == (2, 2, 1, 2, 3, 0)


def test_unusual_requests(spark):
    """Nulls in any column, empty and long texts, repeated rows, clashing names, no rows: defined results and no crash."""
    wide = "/w/" + "x" * 20_000
    asked = [(None, None), ("get", ""), ("GET", wide), ("GET", wide), (None, "/a"), ("GET", "/a", "", "", "", "", ""), ("POST", "/b", "application/json", "[" * 300 + "]" * 300)]
    data = reqs(spark, *asked).withColumns({c: F.lit("x") for c in ("route", "n", "error", "keys", "hit", "params", "parent", "mask")})
    parsed = src.parse(data)
    assert {r["error"] for r in parsed.collect()} == {None, "no URL"}
    for evaluator in ("replay", "set"):
        built = routes.build(parsed, evaluator=evaluator)
        assert rows(routes.methods(built.requests), "route", "method", "requests") == [("", "GET", 1), ("/a", "GET", 2), ("/b", "POST", 1), (wide, "GET", 2)]
        assert [r["need"] for r in lookup.needed(parsed, built).orderBy("seq").collect()] == [True] + [False] * 6
        none = routes.build(parsed.where("false"), evaluator=evaluator)
        assert rows(routes.nodes(none), "node_type") == [("root",)] and lookup.needed(parsed, none).where("not need").count() == 0
        assert routes.snapshot(parsed.where("false"), none).first()["requests_processed"] == 0
    assert lookup.find_routes(parsed.where("false"), built).count() == 0
    assert set(ROUTING_HEADERS.values()) <= set(parsed.columns)


@pytest.fixture(scope="module")
def built_once(spark):
    """Queries that ask the same tree share it here."""
    plain, made = catalog._tree, {}

    def tree_of(spark, sf, *names, evaluator="set"):
        if (sf, names, evaluator) not in made:
            made[sf, names, evaluator] = plain(spark, sf, *names, evaluator=evaluator)
        return made[sf, names, evaluator]

    catalog._tree = tree_of
    yield
    catalog._tree = plain


def test_replay_of_all_requests_by_hand(spark, built_once):
    """The routes of a replay, from plain Python that looks at all siblings anew for each segment."""
    from test_routes import Plain

    rows = [(r["seq"], r["method"], r["keys"]) for r in catalog._parsed(spark, SF, *catalog.ALL).where("error is null").select("seq", "method", "keys").collect()]
    place = {tuple(k): "" for _, _, k in rows}
    first = {k: min(s for s, _, x in rows if tuple(x) == k) for k in place}
    for d in range(max(map(len, place))):
        kids: dict = {}
        for k in sorted(place, key=lambda k: (first[k], k)):
            if len(k) > d:
                at = kids.setdefault(place[k], {})
                at[k[d]] = min(at.get(k[d], first[k]), first[k])
        role = {}
        for parent, segments in kids.items():
            state = Plain(merge.name_of(parent), MergeConfig())
            for s in sorted(segments, key=lambda s: (segments[s], s)):
                state.feed(s)
            role |= {(parent, s): "{" + v[0] + "}" if v else s for s, v in state.role.items()}
        place = {k: p + "/" + role[p, k[d]] if len(k) > d else p for k, p in place.items()}
    want: dict = {}
    for _, m, k in rows:
        want[place[tuple(k)], m] = want.get((place[tuple(k)], m), 0) + 1
    assert {(r["route"], r["method"]): r["requests"] for r in catalog.merge_fold_routes(spark, SF).collect()} == want


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_registered_queries_match_their_sql(spark, built_once, name):
    import duckdb

    got = __spark_entry__.queries()[name](spark, SF)
    sql = __spark_entry__.oracle_sql().get(name)
    data = sorted(str([r[c] for c in sorted(got.columns)]) for r in got.collect())
    assert got.columns and data
    if sql is None:
        return
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert data == sorted(str([r[names.index(c)] for c in sorted(names)]) for r in want.fetchall())
