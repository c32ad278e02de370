"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], and five shapes of work on generated requests; prints one JSON line.

Start-up is reported apart.  ``generated`` has rows a second for $BENCH_ROWS generated requests: a path lookup in a known tree, a tree of
10,000 different ids, parsed JSON bodies, parsed curl lines, and curl lines that become a tree.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.operators import lookup, routes
from routeloom.plans import catalog
from routeloom.sources import requests as src
from routeloom.sources import synthetic
from routeloom.sources.curl import from_curls

HEADLINE = ("url_path_segments", "url_query_params", "json_body_flatten", "form_body_params", "cookie_parse", "type_votes", "merge_decision", "route_counts", "required_params", "is_need_request", "curl_parse")
SPEC = synthetic.Spec(1, (
    synthetic.Resource("users", query=(synthetic.Param("page", ("1", "2", "3")),), fields=(synthetic.Param("name", ("ann", "bob")), synthetic.Param("age", ("21", "34")))),
    synthetic.Resource("orders", ("api", "v1"), "uuid", query=(synthetic.Param("size", ("10", "20"), 0.5),), fields=(synthetic.Param("qty", ("1", "2", "3")),)),
))


def shapes(spark: SparkSession, n: int) -> dict[str, Callable[[], DataFrame]]:
    """What to run, each over n rows; the generated rows are written before, as captured traffic would be."""
    from routeloom.sources.store import materialize

    rows = materialize(synthetic.requests(spark, SPEC, n, ids=10_000))
    posts = materialize(rows.withColumns({"method": F.lit("POST"), "url": F.lit("/api/users"), "content_type": F.lit("application/json"), "body": F.concat(F.lit('{"id":'), F.col("seq").cast("string"), F.lit(',"name":"ann","tags":["a","b"]}'))}))
    lines = materialize(rows.select("seq", F.concat(F.lit("curl -X "), "method", F.lit(" 'http://h.example"), "url", F.lit("' -H 'Accept: text/html'")).alias("line")))
    tree = routes.build(src.parse(rows.limit(20_000)), evaluator="set")
    return {
        "path_lookup": lambda: lookup.probe(src.parse(rows), tree).select("seq", "hit"),
        "merge_ids": lambda: routes.methods(routes.build(src.parse(rows), evaluator="set").requests),
        "json_parse": lambda: src.parse(posts).select("seq", "params"),
        "curl_parse": lambda: from_curls(lines),
        "curl_to_tree": lambda: routes.methods(routes.build(src.parse(from_curls(lines)), evaluator="set").requests),
    }


def timed(made: Callable[[], DataFrame]) -> float:
    began = time.perf_counter()
    made().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sf_dir, cpus, n = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_ROWS", "500000"))
    began = time.perf_counter()
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("routeloom-bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    catalog.entry(spark, sf_dir).count()  # starts the JVM's and the workers' machinery
    startup = time.perf_counter() - began
    took = {name: round(timed(lambda name=name: queries[name](spark, sf_dir)), 3) for name in HEADLINE}
    rates = {name: round(n / timed(made)) for name, made in shapes(spark, n).items()}
    print(json.dumps({
        "metric": "route_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "startup_sec": round(startup, 3), "generated_rows": n, "generated": rates,
    }))


if __name__ == "__main__":
    main()
