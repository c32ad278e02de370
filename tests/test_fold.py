"""Trees kept up to date batch by batch: any split gives the tree of one replay."""

import random

import pytest
from pyspark.sql import functions as F
from test_routes import SCHEMA, reqs

from routeloom.operators import lookup, routes
from routeloom.sources import requests as src
from routeloom.streaming import fold, ingest
from routeloom.streaming.runs import Runs


def text(tree):
    return sorted(map(str, routes.nodes(tree).collect()))


def asked(n, seed):
    rng = random.Random(seed)
    names = ["a", "b", "list", "new", "x.json", "deep-name", "{p_id}"]
    word = lambda: rng.choice([rng.choice(names), str(rng.randint(1, 40)), f"user_{rng.randint(1, 30)}", f"m{rng.choice('abcdef')}@c.co"])
    return [("GET", "/p/" + "/".join(word() for _ in range(rng.randint(0, 4))) + rng.choice(["", "?q=1", f"?q={rng.randint(0, 9)}"])) for _ in range(n)]


@pytest.mark.parametrize("seed", [2])
def test_any_split_gives_one_replay(spark, tmp_path, seed):
    rows = asked(150, seed) + [("GET", "://bad"), ("POST", "/p/1", "application/json", '{"k":1}')]
    parsed = src.parse(reqs(spark, *rows)).cache()
    want = text(routes.build(parsed))
    assert any("request_path_variable" in x for x in want)
    cuts = sorted(random.Random(seed).sample(range(5, 140), 2))
    state = fold.Fold(spark, f"file://{tmp_path}/t")
    for i, (low, high) in enumerate(zip([0, *cuts], [*cuts, 10**6], strict=True)):
        state.update(parsed.where(F.col("seq").between(low, high - 1)), i)
    assert text(state.tree()) == want


def test_moved_children_late_rows_and_repeats(spark, tmp_path):
    """Children of names that become a variable move together; a batch that comes late or again changes nothing but what it must."""
    first = [("GET", f"/u/{i}/{x}") for i in (1, 2) for x in ("a", "b", f"7{i}")]
    second = [("GET", "/u/3/c"), ("GET", "/u/3/99"), ("GET", "/u/4")]
    rows = [(i, *r, *[None] * 5) for i, r in enumerate([*first, *second, ("GET", "/u/2/a"), ("GET", "/u/5/1001")])]
    parsed = src.parse(spark.createDataFrame(rows, SCHEMA)).cache()
    batch = lambda low, high: parsed.where(F.col("seq").between(low, high))
    state = fold.Fold(spark, f"file://{tmp_path}/t", head=2)
    state.update(batch(0, 5), 0)
    state.update(batch(6, 8), 1)
    state.update(batch(6, 8), 1)
    state.update(batch(10, 10), 2)
    assert text(state.tree()) == text(routes.build(parsed.where("seq <> 9")))
    state.update(batch(9, 9), 3)
    assert text(state.tree()) == text(routes.build(parsed))


def test_no_batches(spark, tmp_path):
    empty = fold.Fold(spark, f"file://{tmp_path}/none")
    assert [r["node_type"] for r in routes.nodes(empty.tree()).collect()] == ["root"]
    assert [r["node_type"] for r in routes.nodes(ingest.tree(spark, f"{tmp_path}/nothing")).collect()] == ["root"]


def test_runs_are_merged(spark, tmp_path):
    log = Runs(spark, f"file://{tmp_path}/log", "k string, n long", lambda df: df.groupBy("k").agg(F.sum("n").alias("n")), fan=3)
    put = lambda b, n: log.append(spark.createDataFrame([("x", n), (f"only{b}", 1)], "k string, n long"), b)
    for b in range(14):
        put(b, 1)
        if b in (4, 8):
            put(b, 1)  # once more
    assert log.runs() == [(0, 8), (9, 11), (12, 12), (13, 13)]
    got = {r["k"]: r["n"] for r in log.read().collect()}
    assert got["x"] == 14 and len(got) == 15 and {r["n"] for r in log.read(12).where("k = 'x'").collect()} == {12}


def test_stream_into_a_fold_and_unseen(spark, tmp_path):
    rows = asked(60, 5)
    data = reqs(spark, *rows, ("GET", "://bad"))
    data.repartition(3).write.parquet(str(tmp_path / "in"))
    state = fold.Fold(spark, f"file://{tmp_path}/t")
    query = fold.ingest(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), state, str(tmp_path / "cp"))
    query.awaitTermination()
    counts = [p["observedMetrics"]["requests"] for p in query.recentProgress if p["observedMetrics"]]
    assert sum(c["requests_processed"] for c in counts) == 60 and sum(c["errors"] for c in counts) == 1
    built = state.tree()
    assert text(built) == text(routes.build(src.parse(data)))
    new = [("GET", rows[0][1]), ("GET", rows[0][1] + ("&" if "?" in rows[0][1] else "?") + "other=1"), ("GET", rows[1][1], None, None, "text/html"), ("GET", rows[1][1], None, None, None, None, "s=1"), ("PUT", rows[0][1]), ("GET", None)]
    reqs(spark, *new).write.parquet(str(tmp_path / "more"))
    ingest.unseen(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "more")), built, f"{tmp_path}/unseen", str(tmp_path / "cp2")).awaitTermination()
    assert sorted(r["seq"] for r in spark.read.parquet(f"{tmp_path}/unseen").collect()) == [1, 2, 3, 4, 5]
    assert lookup.needed(src.parse(reqs(spark, new[0])), built).first()["need"] is False
