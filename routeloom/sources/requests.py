"""Captured requests: the schema, parsing with isolated errors, and request tables derived from the sample tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.functions import requests as R
from routeloom.functions.json import json_params
from routeloom.functions.patterns import ROUTING_HEADERS

COLUMNS = ("seq", "method", "url", "content_type", "body", *ROUTING_HEADERS.values(), "cookie")
MAX_ERRORS, MAX_RAW = 100, 128


def body_params(content_type: Column, body: Column, plain: bool = False) -> Column:
    """Parameters of a body by its media type; null if it is malformed; ``plain`` numbers of JSON have no exponents."""
    media, none = R.media_type(content_type), F.array().cast(R.PARAM)
    form = R.query_params(body)
    return (
        F.when(F.coalesce(body, F.lit("")) == "", none)
        .when(media == "application/x-www-form-urlencoded", F.when(~R.bad_params(form), form))
        .when(media == "application/json", json_params(F.when(media == "application/json", body), plain))
        .when(media == "multipart/form-data", R.multipart_params(content_type, body))
        .otherwise(none)
    )


def bad_body(content_type: Column, body: Column) -> Column:
    """Whether a body has no parameters because it is malformed; its leaves aren't opened for that."""
    media = R.media_type(content_type)
    return (
        F.when(F.coalesce(body, F.lit("")) == "", False)
        .when(media == "application/x-www-form-urlencoded", R.bad_params(R.query_params(body)))
        .when(media == "application/json", F.try_parse_json(F.when(media == "application/json", body)).isNull())
        .when(media == "multipart/form-data", R.multipart_params(content_type, body).isNull())
        .otherwise(False)
    )


def with_headers(requests: DataFrame) -> DataFrame:
    """A column for each routing header: that of the requests, else from their map ``headers`` by a name in any case, else null."""
    null = F.lit(None).cast("string")
    of = lambda name: R.header(F.col("headers"), name) if "headers" in requests.columns else null
    return requests.withColumns({column: of(name) for name, column in {**ROUTING_HEADERS, "Cookie": "cookie", "Content-Type": "content_type"}.items() if column not in requests.columns})


def parse(requests: DataFrame) -> DataFrame:
    """Requests with method, keys (path segments as the tree names them), segments, params (name, value, source), media_type and error.

    error is null for rows that parse; a bad row never stops the others.  Of COLUMNS just seq, method, url and body need be there; others
    are null, or taken from a map ``headers``.  A null method is GET, a null URL an error, a null body none; rows that repeat are requests
    of their own; other columns are dropped, whatever their names; an empty table stays empty.
    """
    requests = with_headers(requests)
    # Of equal names in an object the last counts; Spark's parser would else take such a body for a bad one.
    requests.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    query = R.query_params(R.url_query(F.col("url")))
    one = requests.withColumn("method", R.method(F.col("method"))).withColumn("segments", R.path_segments(F.col("url"))).withColumn("query_params", query)
    body = body_params(F.col("content_type"), F.col("body"))
    two = one.withColumn("body_params", R.cut_params(body))
    source_error = F.col("source_error") if "source_error" in requests.columns else F.lit(None).cast("string")
    error = (
        F.when(source_error.isNotNull(), source_error)
        .when(F.col("url").isNull(), "no URL")
        .when(F.startswith("url", F.lit("://")), "missing protocol scheme")
        .when(F.exists("segments", lambda s: s.isNull()), "bad escape in path")
        .when(R.bad_params(F.col("query_params")), "bad query")
        .when(bad_body(F.col("content_type"), F.col("body")), "bad body")
    )
    named = lambda c, source: F.transform(c, lambda p: F.struct(p["name"].alias("name"), p["value"].alias("value"), F.lit(source).alias("source")))
    params = F.concat(named(R.path_params(F.col("segments")), "path"), named(F.col("query_params"), "query"), named(F.col("body_params"), "body"))
    three = two.withColumn("error", error)
    return three.select(
        "seq", "method", "url", "segments", F.transform("segments", R.segment_key).alias("keys"), params.alias("params"), "content_type",
        R.media_type(F.col("content_type")).alias("media_type"), *ROUTING_HEADERS.values(), "cookie", "error",
    )


def batch_errors(parsed: DataFrame) -> DataFrame:
    """The first bad rows, cut short: seq, error, raw."""
    bad = parsed.where("error is not null").select("seq", "error", F.substring(F.coalesce("url", F.lit("")), 1, MAX_RAW).alias("raw"))
    return bad.orderBy("seq").limit(MAX_ERRORS)


def batch_counts(parsed: DataFrame) -> DataFrame:
    return parsed.agg(F.count_if(F.col("error").isNull()).alias("processed"), F.count_if(F.col("error").isNotNull()).alias("failed"))


NULLS = "CAST(NULL AS STRING)"
#: The same text runs in Spark and in DuckDB.
REQUEST_SQL = {
    "req_pages": f"SELECT CAST(page_id AS BIGINT) AS seq, 'GET' AS method, url, {NULLS} AS content_type, {NULLS} AS body, {NULLS} AS accept, {NULLS} AS authorization, {NULLS} AS cookie FROM pages",
    "req_orders": "SELECT CAST(o_orderkey AS BIGINT) AS seq, CASE o_orderstatus WHEN 'F' THEN 'GET' WHEN 'O' THEN 'PUT' ELSE 'DELETE' END AS method, concat('/api/customers/', CAST(o_custkey AS STRING), '/orders?Page=', CAST(o_orderkey % 7 AS STRING), CASE WHEN o_orderkey % 3 = 0 THEN concat('&prio=', substr(o_orderpriority, 1, 1)) ELSE '' END) AS url,"
    f" {NULLS} AS content_type, {NULLS} AS body, CASE WHEN o_orderkey % 2 = 0 THEN 'application/json, text/html;q=0.9' ELSE 'text/html' END AS accept, concat(CASE WHEN o_orderkey % 5 = 0 THEN 'Basic ' ELSE 'Bearer ' END, CAST(o_custkey AS STRING)) AS authorization, concat('lang=', CASE WHEN o_orderkey % 2 = 0 THEN 'en-US' ELSE 'zh-CN' END, '; theme=dark') AS cookie FROM orders",
    "req_events": f"SELECT CAST(event_id AS BIGINT) AS seq, 'POST' AS method, concat('/track/', event_type, '?uid=', CAST(user_id AS STRING)) AS url, 'application/json; charset=utf-8' AS content_type, props AS body, {NULLS} AS accept, {NULLS} AS authorization, {NULLS} AS cookie FROM events",
    "req_suppliers": "SELECT CAST(s_suppkey AS BIGINT) AS seq, 'GET' AS method, concat(CASE s_suppkey % 2 WHEN 0 THEN '/pre/user_' ELSE '/suf/' END, lpad(CAST(s_suppkey AS STRING), 5, '0'), CASE s_suppkey % 2 WHEN 0 THEN '' ELSE '_user' END) AS url,"
    f" {NULLS} AS content_type, {NULLS} AS body, {NULLS} AS accept, {NULLS} AS authorization, {NULLS} AS cookie FROM supplier",
    "req_parts": "SELECT CAST(p_partkey AS BIGINT) AS seq, 'POST' AS method, CASE WHEN p_partkey % 10 = 0 THEN '/parts/list' WHEN p_partkey % 10 = 1 THEN '/parts/create' ELSE concat('/parts/', CAST(p_partkey AS STRING)) END AS url, 'application/x-www-form-urlencoded' AS content_type,"
    f" concat('type=', p_type, '&size=', CAST(p_size AS STRING), '&price=', CAST(p_partkey % 100 AS STRING), '.50', CASE WHEN p_partkey % 20 = 0 THEN '' ELSE concat('&brand=', replace(p_brand, '#', '%23')) END) AS body, {NULLS} AS accept, {NULLS} AS authorization, {NULLS} AS cookie FROM part",
    "req_formats": "SELECT CAST(c_custkey AS BIGINT) AS seq, 'GET' AS method, concat('/fmt/', CASE c_custkey % 4 WHEN 0 THEN concat('phone/138', lpad(CAST(c_custkey AS STRING), 8, '0')) WHEN 1 THEN concat('card/62220', lpad(CAST(c_custkey AS STRING), 12, '0'))"
    " WHEN 2 THEN concat('uuid/', substr(md5(CAST(c_custkey AS STRING)),1,8), '-', substr(md5(CAST(c_custkey AS STRING)),9,4), '-', substr(md5(CAST(c_custkey AS STRING)),13,4), '-', substr(md5(CAST(c_custkey AS STRING)),17,4), '-', substr(md5(CAST(c_custkey AS STRING)),21,12))"
    " ELSE concat('id/1101011990', lpad(CAST(1 + c_custkey % 12 AS STRING), 2, '0'), lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0'), lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), 'X') END, '?seg=', c_mktsegment) AS url,"
    f" {NULLS} AS content_type, {NULLS} AS body, {NULLS} AS accept, {NULLS} AS authorization, {NULLS} AS cookie FROM customer",
}
TABLE_OF = {"req_pages": "pages", "req_orders": "orders", "req_events": "events", "req_suppliers": "supplier", "req_parts": "part", "req_formats": "customer"}


def request_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return request_rows(spark, spark.read.parquet(f"{sf_dir}/{TABLE_OF[name]}.parquet"), name)


def request_rows(spark: SparkSession, source: DataFrame, name: str) -> DataFrame:
    """The requests of a source table, or of a stream of its rows."""
    return spark.sql(REQUEST_SQL[name].replace(f"FROM {TABLE_OF[name]}", "FROM {source}"), source=source)
