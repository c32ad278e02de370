"""Parsing, inference, merging, lookups, documents and streams of the route tree."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from routeloom.functions import requests as R
from routeloom.functions import types as T
from routeloom.operators import documents, inference, lookup, merge, routes
from routeloom.operators.merge import MERGE, SKIP, MergeConfig, Siblings
from routeloom.sources import requests as src
from routeloom.sources.curl import CurlError, from_curls, parse_curl, tokens

SCHEMA = "seq long, method string, url string, content_type string, body string, accept string, authorization string, cookie string"


def reqs(spark, *rows):
    return spark.createDataFrame([(i, *r, *[None] * (7 - len(r))) for i, r in enumerate(rows)], SCHEMA)


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("url", "segments", "query"),
    [
        ("http://h/a/b?x=1", ["a", "b"], "x=1"),
        ("/a//b/", ["a", "b"], ""),
        ("//h/a?q", ["a"], "q"),
        ("http://h", [], ""),
        ("http://h?x=1", [], "x=1"),
        ("/a/./../b", ["a", "b"], ""),
        ("/a%20b/c+d", ["a b", "c+d"], ""),
        ("/a#top", ["a#top"], ""),
        ("", [], ""),
        ("/a/%zz", ["a", None], ""),
    ],
)
def test_url_parts(spark, url, segments, query):
    row = spark.createDataFrame([(url,)], "url string").select(R.path_segments(F.col("url")).alias("s"), R.url_query(F.col("url")).alias("q")).first()
    assert (row["s"], row["q"]) == (segments, query)


def test_query_params_keep_order_and_repeats(spark):
    assert [tuple(p) for p in one(spark, "B=1&a=x+y&B=2&flag&=v&c=%E4%BD%A0", R.query_params)] == [("b", "1"), ("a", "x y"), ("b", "2"), ("flag", ""), ("", "v"), ("c", "你")]
    assert one(spark, "a=1;b=2", lambda x: R.bad_params(R.query_params(x)))
    assert one(spark, "a=%zz", lambda x: R.bad_params(R.query_params(x)))


def test_cookies_last_wins(spark):
    assert [tuple(c) for c in one(spark, "a=1; b ; a=2;; c=x=y", R.cookies)] == [("b", ""), ("a", "2"), ("c", "x=y")]


@pytest.mark.parametrize(
    ("value", "kind"),
    [("", "null"), ("NULL", "null"), ("true", "boolean"), ("True", "string"), ("-12", "integer"), ("+", "integer"), ("1234567890123456", "string"), ("0xFf", "integer"), ("1e5", "float"), (".", "float"),
     ("1.2.3", "string"), ("[1]", "array"), ("{}", "object"), ("12\n", "string")],
)
def test_physical(spark, value, kind):
    assert one(spark, value, T.physical) == kind


@pytest.mark.parametrize(
    ("value", "kind"),
    [("138-1234-5678", "phone"), ("13812345678@qq.com", "phone"), ("a@b.co", "email"), ("10.0.0.1", "ipaddress"), ("2001:db8::1", "ipaddress"), ("::1", "ipaddress"), ("1:2", None), ("2024-01-02", "date"),
     ("2024-01-02T03:04:05Z", "datetime"), ("03:04:05", "time"), ("https://x", "url"), ("{\"a\":1}", "json"), ("<a/>", "xml"), ("京A12345", "plate"), ("110101199001011234", "idcard"), ("6222021234567890123", "bankcard")],
)
def test_logical(spark, value, kind):
    assert one(spark, value, T.pattern_type) == kind


def test_votes(spark):
    rows = [("a", "1", 3), ("a", "x", 2), ("e", "red", 5), ("e", "blue", 5), ("m", "1.50", 2), ("m", "2.25", 2), ("p", "13812345678", 6), ("p", "12345678901", 4), ("t", "1", 1), ("t", "x", 1)]
    got = {r["o"]: (r["physical_type"], r["logical_type"]) for r in inference.votes(spark.createDataFrame(rows, "o string, value string, cnt long"), ["o"]).collect()}
    assert got == {"a": ("integer", "string"), "e": ("string", "enum"), "m": ("float", "decimal"), "p": ("integer", "phone"), "t": ("integer", "string")}
    chain = inference.RuleChain(inference.physical_rule).add(inference.logical_rule)
    assert {r["o"]: r["type"] for r in chain.infer(spark.createDataFrame(rows, "o string, value string, cnt long"), ["o"]).collect()}["e"] == "enum"


def roles(values, name="users", config=MergeConfig(), rule=None):
    s = Siblings(name, config, rule)
    for v in values:
        s.feed(v)
    return {v: r[0] if r else None for v, r in s.role.items()}


def test_replay_decisions():
    assert set(roles(["123", "456", "789"]).values()) == {"users_id"}
    got = roles(["list", "create", "101", "102", "103", "104"])
    assert got["list"] is None and got["create"] is None and got["104"] == "users_id"
    assert set(roles(["data.json", "data.xml", "data.html"]).values()) == {None}
    assert set(roles(["admin", "manager", "guest"]).values()) == {None}
    assert set(roles(["北京", "上海", "广州", "深圳", "杭州", "成都"], "city").values()) == {"var_city"}
    assert set(roles(["user_001", "user_002", "user_003"]).values()) == {"user_id"}
    assert set(roles(["001_user", "002_user", "003_user"]).values()) == {"user_id"}
    assert set(roles(["1", "2", "3"], config=MergeConfig(sibling_merge_threshold=5)).values()) == {None}
    assert set(roles(["1", "2", "3"], rule=lambda *a: (SKIP, [])).values()) == {None}
    assert set(roles(["a", "b", "c"], rule=lambda n, v, *a: (MERGE, v)).values()) == {"var_users"}


def test_both_evaluators_agree_on_one_pattern(spark):
    rows = [("/api/users", str(100 + i), i) for i in range(20)] + [("/x", f"v{i}", i) for i in range(5)] + [("/y", w, i) for i, w in enumerate(["one", "fourteen"])]
    sib = spark.createDataFrame(rows, "parent string, segment string, first_seq long")
    a = {tuple(r) for r in merge.evaluate(sib.drop("first_seq")).select("parent", "segment", "variable").collect()}
    b = {tuple(r) for r in merge.replay(sib, head=7).select("parent", "segment", "variable").collect()}
    assert a == b and ("/x", "v1", "x_version") in a


def test_curl():
    got = parse_curl("curl -XPUT --max-time 30 'http://h/a' -H 'Accept: x' -d '{\"a\":1}'")
    assert (got["method"], got["url"], got["body"], got["headers"]["Content-Type"]) == ("PUT", "http://h/a", '{"a":1}', "application/x-www-form-urlencoded")
    assert parse_curl("curl http://h?a=1 -G -d b=2")["url"] == "http://h?a=1&b=2"
    assert parse_curl("curl --url http://z http://h")["url"] == "http://z"
    assert parse_curl("curl http://h -d x -X GET")["method"] == "POST"
    assert tokens("a 'b c' \"d\\\"e\" f\\ g \\\n h") == ["a", "b c", 'd"e', "f g", "h"]
    for bad in ("", "wget x", "curl", "curl 'x", "curl http://h -H", "curl http://h -H nocolon"):
        with pytest.raises(CurlError):
            parse_curl(bad)


@pytest.fixture(scope="module")
def tree(spark):
    json_type, auth = "application/json", "Bearer t"
    rows = [
        ("GET", "/api/users?page=1&size=10", None, None, None, auth), ("GET", "/api/users?page=2&size=20", None, None, None, auth),
        *[("GET", f"/api/users/{i}", None, None, None, auth) for i in (123, 456, 789)],
        ("POST", "/api/users", json_type, '{"name":"a","age":1}', None, auth), ("PUT", "/api/users/123", json_type, '{"name":"b"}', None, auth), ("DELETE", "/api/users/123", None, None, None, auth),
    ]
    return routes.build(src.parse(reqs(spark, *rows)))


def test_worked_example(spark, tree):
    assert {(r["route"], r["method"]): r["requests"] for r in routes.methods(tree.requests).collect()} == {
        ("/api/users", "GET"): 2, ("/api/users", "POST"): 1, ("/api/users/{users_id}", "GET"): 3, ("/api/users/{users_id}", "PUT"): 1, ("/api/users/{users_id}", "DELETE"): 1,
    }
    params = {(r["method"], r["name"]): (r["required"], r["physical_type"]) for r in routes.params(tree.requests).collect()}
    assert params[("GET", "page")] == (True, "integer") and params[("POST", "name")] == (False, "string")
    nodes = routes.nodes(tree)
    doc = documents.openapi(nodes)
    assert doc["components"]["securitySchemes"]["bearerAuth"]["scheme"] == "bearer"
    variable = next(p for p in doc["paths"]["/api/users/{users_id}"]["get"]["parameters"] if p["in"] == "path")
    assert variable["schema"] == {"type": "integer", "pattern": "[0-9]+"}
    assert "name" in doc["paths"]["/api/users"]["post"]["requestBody"]["content"]["application/json"]["schema"]["properties"]
    text = documents.to_text(nodes)
    assert "{users_id} [Var, integer]" in text and "page* [Param]" in text
    back = documents.from_json(spark, documents.to_json(nodes))
    same = ["node_type", "key", "pattern", "required"]
    assert sorted(map(str, back.select(*same).collect())) == sorted(map(str, nodes.select(*same).collect()))
    assert routes.stats(nodes).first()["request_method"] == 5


def test_lookups(spark, tree):
    asked = src.parse(reqs(spark, ("GET", "/api/users/999", None, None, None, "Bearer z"), ("GET", "/api/users?page=9&size=1"), ("GET", "/api/users?new=1"), ("PATCH", "/api/users/1"), ("GET", "/nope"), ("GET", "://x"), ("GET", "/api/users/1", None, None, None, "Basic z"), ("POST", "/api/users", "text/plain")))
    assert [r["need"] for r in lookup.needed(asked, tree).orderBy("seq").collect()] == [False, False, True, True, True, True, True, True]
    assert [r["route"] for r in lookup.find_routes(asked, tree).orderBy("seq").collect()] == ["/api/users/{users_id}", "/api/users", "/api/users", None, None, None, "/api/users/{users_id}", "/api/users"]


def test_bad_rows_stay_apart(spark):
    parsed = src.parse(reqs(spark, ("GET", "/ok"), ("GET", "://x"), ("GET", "/a/%zz"), ("GET", "/a?x=%zz"), ("POST", "/a", "application/json", "{"), ("GET", None)))
    assert src.batch_counts(parsed).first().asDict() == {"processed": 1, "failed": 5}
    assert [r["error"] for r in src.batch_errors(parsed).collect()] == ["missing protocol scheme", "bad escape in path", "bad query", "bad body", "no URL"]


def test_multipart_and_curl_source(spark):
    body = '--X\r\nContent-Disposition: form-data; name="A"\r\n\r\nv\r\n--X\r\nContent-Disposition: form-data; name="f"; filename="x.txt"\r\n\r\nzzz\r\n--X--'
    got = spark.createDataFrame([(body,)], "b string").select(R.multipart_params(F.lit("multipart/form-data; boundary=X"), F.col("b")).alias("p")).first()["p"]
    assert [tuple(p) for p in got] == [("a", "v"), ("f", "x.txt")]
    rows = from_curls(spark.createDataFrame([(1, "curl http://h/a -d x=1"), (2, "nope")], "seq long, line string"))
    assert [(r["method"], r["source_error"]) for r in rows.orderBy("seq").collect()] == [("POST", None), (None, "not a curl command")]


def test_stream_equals_batch(spark, tmp_path):
    from routeloom.streaming import ingest as st

    rows = reqs(spark, *[("GET", f"/a/{i % 3}") for i in range(12)])
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    st.ingest(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {tuple(r["keys"]): r["n"] for r in st.facts(spark, str(tmp_path / "out")).collect()}
    assert got == {tuple(r["keys"]): r["n"] for r in routes.compact(src.parse(rows)).collect()}


def test_replay_goes_on_from_the_head(spark):
    mixed = ["about", "101", "102", "103", "login", "users", "items", "posts", "admin", "a@b.co", "c@d.co", "104", "pages", "e@f.co", "x.json", "105", "other", "g@h.co", "a1b2", "logout-everything"]
    sets = {"/m": mixed, "/mail": ["welcome-to-all", "a@b.co", "c@d.co", "longer-word-here", "e@f.co"], "/ids": [str(i) for i in range(30)], "/w": ["one", "fourteen", "list", "n", "abcdefghijk"]}
    rows = [(p, v, i) for p, values in sets.items() for i, v in enumerate(values)]
    sib = spark.createDataFrame(rows, "parent string, segment string, first_seq long")
    whole = {(p, v, *(r or (None, None))) for p, values in sets.items() for v, r in _state(p, values).items()}
    for head in (1, 3, 4, 9, 11, 1000):
        got = [tuple(r) for r in merge.replay(sib, head=head).select("parent", "segment", "variable", "regex").collect()]
        assert len(got) == len(rows) and set(got) == whole, head


def _state(parent, values):
    s = Siblings(parent[1:], MergeConfig())
    for v in values:
        s.feed(v)
    return s.role


def test_deep_paths_stay_whole(spark):
    deep = "/d" * 40
    tree = routes.build(src.parse(reqs(spark, ("GET", deep + "/left?a=1"), ("GET", deep + "/right"), ("GET", "/d"))), evaluator="set")
    assert {r["route"] for r in routes.methods(tree.requests).collect()} == {deep + "/left", deep + "/right", "/d"}
    assert routes.stats(routes.nodes(tree)).first()["request_path"] == 42
    asked = src.parse(reqs(spark, ("GET", deep + "/right"), ("GET", deep + "/none"), ("GET", deep + "/right/more"), ("GET", "/d"), ("GET", "/e")))
    began = time.perf_counter()
    assert [r["need"] for r in lookup.needed(asked, tree).orderBy("seq").collect()] == [False, True, True, False, True]
    assert time.perf_counter() - began < 20


def test_prefix_index_walks_like_joins(spark):
    """Random trees with variables, names beside them and dead ends: both ways to ask find the same routes."""
    rng = random.Random(9)
    word = lambda: rng.choice(["a", "b", "list", "x.json", str(rng.randint(1, 60)), f"u{rng.randint(1, 30)}", "{a_id}"])
    asked = [("GET", "/" + "/".join(word() for _ in range(rng.randint(0, 5)))) for _ in range(400)]
    parsed = src.parse(reqs(spark, *asked, ("GET", "://bad"), ("GET", None)))
    tree = routes.build(parsed.where("seq < 250"))
    assert tree.paths.where("node_type = 'request_path_variable'").count() > 3
    depth = tree.paths.agg(F.max("depth")).first()[0]
    one = {r["seq"]: r["hit"] for r in lookup.walk(parsed, tree, depth).select("seq", "hit").collect()}
    two = {r["seq"]: r["hit"] for r in lookup.by_prefixes(parsed, tree, depth).select("seq", "hit").collect()}
    assert one == two and len(one) == 402 and None in one.values() and "" in one.values()
    none = routes.build(parsed.where("false"))
    assert lookup.by_prefixes(parsed, none, 0).where("hit is not null and hit <> ''").count() == 0


class Plain(Siblings):
    """Decisions from all fixed siblings anew, each time."""

    def detect(self):
        import os.path

        values, patterns = list(self.fixed), merge._PY
        n = len(values)
        hits = {k: sum(p.search(v) is not None for v in values) for k, p in patterns.items()}
        best = max(hits.values())
        if best * 2 < n:
            head = re.sub(r"[0-9]+\Z", "", os.path.commonprefix(values))
            tail = re.sub(r"\A[0-9]+", "", os.path.commonprefix([v[::-1] for v in values])[::-1])
            good = lambda x: x == "" or x.lstrip("+-").isdigit() and x.isascii() and not re.match("[+-]{2}", x) or x in ("+", "-") or re.fullmatch("[A-Za-z0-9]+", x) and re.search("[A-Za-z]", x) and re.search("[0-9]", x)
            for kind, affix, rests in (("prefix", head, [v[len(head):] for v in values if len(v) > len(head)]), ("suffix", tail, [v[:len(v) - len(tail)] for v in values if len(v) > len(tail)])):
                share = sum(1 for x in rests if good(x)) / n if affix and n >= 3 else 0
                if share >= 0.6:
                    return kind, share
            sizes = [len(v.encode()) for v in values]
            share = sum(abs(x - int(sum(sizes) / n)) <= 2 for x in sizes) / n
            if share >= 0.8:
                return "similar_length_strings", share
        return (next(k for k, v in hits.items() if v == best) if best else ""), best / n

    def choose(self):
        self.members = {k: {v: None for v in self.fixed if p.search(v)} for k, p in merge._PY.items()}
        return super().choose()


def test_replay_keeps_what_a_new_look_finds():
    rng = random.Random(21)
    kinds = [
        lambda: str(rng.randint(0, 10**6)), lambda: f"user_{rng.randint(0, 999)}", lambda: f"{rng.randint(0, 999)}-item", lambda: rng.choice(["list", "new", "edit"]) + rng.choice(["", ".json", "-all"]), lambda: f"u{rng.randint(0, 99)}@b.co",
        lambda: "".join(rng.choice("abcdef-") for _ in range(rng.randint(1, 30))), lambda: rng.choice("北上广深") * rng.randint(1, 4), lambda: f"pre-{rng.choice(['x', 'y', 'long-word'])}-{rng.randint(0, 50)}", lambda: f"v{rng.randint(0, 20)}", lambda: "",
    ]
    for _ in range(150):
        some = rng.sample(kinds, rng.randint(1, 5))
        values = [rng.choice(some)() for _ in range(rng.randint(3, 80))]
        config = MergeConfig(sibling_merge_threshold=rng.choice([3, 3, 5]), similar_length_break_threshold=rng.choice([0, 6, 30]), selective_only=rng.random() < 0.3)
        one, two = Siblings("p", config), Plain("p", config)
        for v in values:
            one.feed(v)
            two.feed(v)
        assert one.role == two.role and one.variables == two.variables, values


def test_replay_of_many_slugs(spark):
    """Words of many lengths that never merge, and three of another pattern at a time: time grows with the number of segments."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.choice([3, 9, 15, 21, 27])))
    slugs = [f"{word()}-{word()}" for _ in range(100_000)]
    for i in range(0, len(slugs), 10):
        slugs[i] = f"{word()}@example.org"
    slugs[:3] = ["101", "102", "103"]
    began = time.process_time()
    state = Siblings("blog", MergeConfig(similar_length_break_threshold=0))
    for v in slugs:
        state.feed(v)
    assert time.process_time() - began < 60
    assert len(state.role) == len(set(slugs)) and sum(r is None for r in state.role.values()) > 85_000 and len(state.variables) > 3_000
