"""Mixing sources to target weights with hash-threshold histograms.

Every row gets a fixed hash from its id.  A source that must contribute ``target`` tokens takes each row
``floor(target / size)`` times, and once more the rows whose hash lies below a threshold.  The threshold of each
source comes from a histogram of tokens by (source, hash bucket): the bucket in which the running total passes
the budget is found, and only that bucket is split into finer buckets, level by level.  Nothing is sorted and no
row-level data leaves the executors; thresholds of smaller budgets are nested in those of larger ones.

Behaviour on unusual input: a null text has size 0; a null source is a source of its own (last in order); rows
that repeat share their hash and so are taken or left together; an empty table gives an empty mix; columns of the
input besides those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from routeloom.llm._common import keep, table, word_count

#: The hash has 60 bits; a level of the histogram looks at so many of them.
LEVEL_BITS = (12, 16, 16, 16)


def row_hash(key: Column) -> Column:
    """60 bits of the MD5 of the key, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Targets for one row per source (source, source_size): ``share`` of all sizes dealt out by weight, at most ``cap`` times a size each.

    What a capped source cannot take goes to the others by weight, until none is above.  That is water-filling
    with one level L: target = min(cap * size, weight * L).  Ordered by cap * size / weight, the first sources are the
    capped ones, so L follows from running sums over the (few) sources.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("rank", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    top = ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * cap).alias("top"))
    by_level = Window.orderBy(F.col("top") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    filled = top.select(
        "*",
        (F.sum("source_size").over(whole) * share).alias("budget"),
        (F.sum("top").over(by_level.rowsBetween(Window.unboundedPreceding, -1))).alias("below"),
        F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)).alias("open"),
    )
    level = (F.col("budget") - F.coalesce("below", F.lit(0.0))) / F.col("open")
    # The level is right at the first source that it does not fill up.
    found = filled.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("top") / F.col("weight"))
    final = F.min(F.when(F.col("fits"), F.struct(F.col("top") / F.col("weight"), F.col("level")))).over(whole)["level"]
    return found.select("source", "source_size", F.coalesce(F.least(F.col("top"), F.col("weight") * final), F.col("top")).alias("target"))


def hash_thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, threshold): rows of the source whose hash is below the threshold sum to its budget, as near as whole rows allow.

    rows: source, size, h.  budgets: source, budget.  Both sides of each join are aggregates by source.
    """
    state = budgets.select("source", "budget", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("got"))
    left = sum(LEVEL_BITS)
    for bits in LEVEL_BITS:
        span, left = left, left - bits
        one = F.shiftright(F.col("h") - F.col("low"), left)
        inside = rows.join(state, rows["source"].eqNullSafe(state["source"])).drop(state["source"])
        inside = inside.where((F.col("h") >= F.col("low")) & (F.col("h") < F.col("low") + F.lit(1 << span)))
        bins = inside.groupBy("source", "budget", "low", "got", one.alias("bucket")).agg(F.sum("size").alias("tokens"))
        run = Window.partitionBy("source").orderBy("bucket")
        sums = bins.withColumn("upto", F.sum("tokens").over(run) + F.col("got")).withColumn("before", F.col("upto") - F.col("tokens"))
        # The bucket is taken whole if its middle lies below the budget at the finest level; else it is the one to refine.
        passed = F.col("upto") <= F.col("budget") if left else (F.col("upto") - F.col("tokens") / 2) <= F.col("budget")
        edge = sums.where(~passed).groupBy("source").agg(F.min(F.struct("bucket", "before")).alias("edge"))
        state = state.join(edge, state["source"].eqNullSafe(edge["source"]), "left").drop(edge["source"])
        # Without such a bucket all rows of the range are taken.
        state = state.select(
            "source", "budget",
            F.coalesce(F.col("low") + F.shiftleft(F.col("edge.bucket"), left), F.col("low") + F.lit(1 << span)).alias("low"),
            F.coalesce("edge.before", "got").cast("long").alias("got"),
        )
        state = keep(rows.sparkSession, state)
    return state.select("source", F.col("low").alias("threshold"))


def source_goals(rows: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source of rows (source, size, h): source_size, target, and the whole times and the threshold by which rows are taken."""
    spark = rows.sparkSession
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = keep(spark, source_targets(sources, weights, share, cap))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    whole = F.least(whole, F.lit(int(cap)))
    goals = goals.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    limits = hash_thresholds(rows, goals.where(F.col("whole") < int(cap)).select("source", "budget"))
    return keep(spark, goals.join(limits, goals["source"].eqNullSafe(limits["source"]), "left").drop(limits["source"]))


def copies(h: Column, whole: Column, threshold: Column) -> Column:
    return (whole + F.when(h < threshold, 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, size: Column, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0, key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, source, size, h, source_size, target, copies (how often the mix takes it)."""
    rows = keep(docs.sparkSession, docs.select(key, "source", size.alias("size"), row_hash(F.col(key)).alias("h")))
    goals = source_goals(rows, weights, share, cap)
    # One row per source: Spark broadcasts it only where its measured size is below the session's threshold.
    out = rows.join(goals, rows["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    return out.select(key, "source", "size", "h", "source_size", "target", copies(F.col("h"), F.col("whole"), F.col("threshold")).alias("copies"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), word_count(F.col("text")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) - 1 AS rk FROM s),
w AS (SELECT *, CAST(CASE rk % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS top FROM r),
f AS (
  SELECT *, (SELECT sum(source_size) FROM s) * 1.5::DOUBLE AS budget, top / weight AS lv,
         coalesce(sum(top) OVER (ORDER BY top / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
         sum(weight) OVER (ORDER BY top / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM w),
l AS (SELECT arg_min((budget - below) / open, lv) AS level FROM f WHERE (budget - below) / open <= lv),
t AS (SELECT source, source_size, least(top, weight * coalesce(level, top / weight)) AS target FROM f, l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN least(2, floor(target / source_size)) ELSE 0 END AS whole FROM t),
b AS (SELECT *, target - whole * source_size AS budget FROM g),
hs AS (SELECT source, h, sum(size) AS tokens FROM d GROUP BY source, h),
c AS (SELECT source, h, tokens, sum(tokens) OVER (PARTITION BY source ORDER BY h) AS upto FROM hs)
SELECT d.doc_id, d.size, b.source_size, b.target,
       CAST(d.size * (b.whole + CASE WHEN b.whole < 2 AND c.upto - c.tokens / 2.0 <= b.budget THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.h = c.h
"""
