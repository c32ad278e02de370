"""Types of a histogram's owner: one row for each key from (key..., value, cnt).

All votes are sums over the histogram, so the work follows the number of distinct values, and partial sums combine before
the shuffle.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.functions import types as T
from routeloom.functions.patterns import LOGICAL_PATTERNS, PHYSICAL_TYPES

#: (histogram, keys) to (keys, physical_type, logical_type): what gives nodes their types.
Infer = Callable[[DataFrame, Sequence[str]], DataFrame]

ENUM_SHARE, PATTERN_SHARE = 0.3, 0.6


def histogram(rows: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """(keys, value, cnt, first_seq); rows with n count so many times."""
    cnt = F.sum("n") if "n" in rows.columns else F.count("*")
    first = F.min("seq").alias("first_seq") if "seq" in rows.columns else F.lit(None).cast("long").alias("first_seq")
    return rows.groupBy(*keys, F.col(value).alias("value")).agg(cnt.alias("cnt"), first)


#: A bit for each pattern, so that each is tried once for a value; the lowest that is set is the first type that fits.
_BIT = {name: 1 << i for i, name in enumerate(LOGICAL_PATTERNS)}
FORMATS = ("percentage", "currency", "decimal")


def _marked(rows: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """Values with what votes are about: physical type, patterns that fit, number format, bytes."""
    v = F.col("value")
    mask = sum((F.when(T.matches(name, v), b).otherwise(0) for name, b in _BIT.items()), F.lit(0))
    return rows.where(v.isNotNull()).select(*keys, "value", F.col(weight).alias("cnt"), T.physical(v).alias("p"), mask.alias("mask"), T.number_format(v).alias("f"), F.octet_length(v).alias("bytes"))


def _has(name: str) -> Column:
    return F.col("mask").bitwiseAND(F.lit(_BIT[name])) != 0


def _vote_sums() -> list[Column]:
    """Sums that need no different values: exact, of constant size, and combined before the shuffle."""
    lowest = F.col("mask").bitwiseAND(-F.col("mask"))
    total = lambda cond: F.sum(F.when(cond, F.col("cnt")).otherwise(0))
    return [
        F.sum("cnt").alias("total"), F.max("bytes").alias("longest"), *[total(F.col("p") == n).alias(f"p_{n}") for n in PHYSICAL_TYPES],
        *[total(lowest == _BIT[n]).alias(f"l_{n}") for n in LOGICAL_PATTERNS], *[total(F.col("f") == n).alias(f"f_{n}") for n in FORMATS],
    ]


def votes(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n_values, total, physical_type, logical_type); null values are left out."""
    distinct = [F.count("*").alias("n_values"), F.greatest(*[F.count_if(_has(n)) for n in LOGICAL_PATTERNS]).alias("most_in_pattern")]
    return _types(_marked(hist, keys, "cnt").groupBy(*keys).agg(*distinct, *_vote_sums()), keys)


def _types(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    best = F.greatest(*[F.col(f"p_{n}") for n in PHYSICAL_TYPES])
    physical = F.coalesce(*[F.when(F.col(f"p_{n}") == best, n) for n in PHYSICAL_TYPES])
    share = lambda c: F.col(c) / F.col("total") >= PATTERN_SHARE
    logical = F.coalesce(
        *[F.when(share(f"l_{n}"), n) for n in LOGICAL_PATTERNS],
        *[F.when(share(f"f_{n}"), n) for n in FORMATS],
        F.when(is_enum(), "enum"),
        F.lit("string"),
    )
    out = sums.select(*keys, "n_values", "total", physical.alias("physical_type"), logical.alias("logical_type"))
    same = (F.col("logical_type") == F.col("physical_type")) & (F.col("physical_type") != "string")
    return out.withColumn("logical_type", F.when(same, "string").otherwise(F.col("logical_type")))


#: Registers of a sketch are 2 ** LG; its relative standard error is about 0.83 / 2 ** (LG / 2), 1.3% at 12.
LG = 12


def sketch(rows: DataFrame, keys: Sequence[str], lg: int = LG) -> DataFrame:
    """A row of constant size for each key, whatever the number of its values: exact vote sums, and sketches of the different values.

    rows: (keys, value), with n where given.  Sketches of parts of the rows are put together by ``merge_sketches``; ``votes_of_sketches`` gives types.
    """
    weighted = rows if "n" in rows.columns else rows.withColumn("n", F.lit(1).cast("long"))
    distinct = [F.hll_sketch_agg("value", F.lit(lg)).alias("values"), *[F.hll_sketch_agg(F.when(_has(n), F.col("value")), F.lit(lg)).alias(f"v_{n}") for n in LOGICAL_PATTERNS]]
    return _marked(weighted, keys, "n").groupBy(*keys).agg(*distinct, *_vote_sums())


def merge_sketches(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each key of sketches of several parts."""
    how = lambda c: F.hll_union_agg(c, F.lit(True)) if c == "values" or c.startswith("v_") else F.max(c) if c == "longest" else F.sum(c)
    return sketches.groupBy(*keys).agg(*[how(c).alias(c) for c in sketches.columns if c not in keys])


def votes_of_sketches(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As ``votes``; n_values is an estimate, all other votes are exact.  Only an enum near its limits may be told otherwise."""
    most = F.greatest(*[F.hll_sketch_estimate(f"v_{n}") for n in LOGICAL_PATTERNS])
    return _types(sketches.withColumns({"n_values": F.hll_sketch_estimate("values"), "most_in_pattern": most}), keys)


def votes_in_bounds(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``votes`` by way of sketches: an Infer for parameters with more values than a histogram should hold."""
    return votes_of_sketches(sketch(hist.withColumn("n", F.col("cnt")), keys), keys)


def is_enum() -> Column:
    """Few short distinct values for many observations, most of them in no pattern."""
    few = (F.col("n_values") >= 2) & (F.col("total") >= 3) & (F.col("n_values") / F.col("total") <= ENUM_SHARE)
    return few & (F.col("longest") <= 50) & (F.col("most_in_pattern") / F.col("n_values") <= 0.5)


Rule = Callable[[DataFrame, Sequence[str]], DataFrame]


class RuleChain:
    """Inference rules in order: each gives (keys, type), null where it knows nothing; a later type other than string wins."""

    def __init__(self, *rules: Rule):
        self.rules = list(rules)

    def add(self, rule: Rule) -> RuleChain:
        self.rules.append(rule)
        return self

    def _each(self, hist: DataFrame, keys: Sequence[str]) -> DataFrame:
        """(keys, t0, t1...): what each rule says, asked once."""
        out = hist.select(*keys).distinct()
        for i, rule in enumerate(self.rules):
            out = out.join(rule(hist, keys).select(*keys, F.col("type").alias(f"t{i}")), list(keys), "left")
        return out

    def _last(self) -> Column:
        strong = [F.when(F.col(f"t{i}") != "string", F.col(f"t{i}")) for i in reversed(range(len(self.rules)))]
        return F.coalesce(*strong, F.lit("string"))

    def infer(self, hist: DataFrame, keys: Sequence[str]) -> DataFrame:
        return self._each(hist, keys).select(*keys, self._last().alias("type"))

    def __call__(self, hist: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Types for a tree (an Infer): the first rule's is the physical one, the chain's the logical one, string where both are the same."""
        first = F.col("t0") if self.rules else F.lit(None).cast("string")
        both = self._each(hist, keys).select(*keys, first.alias("physical_type"), self._last().alias("type"))
        same = F.coalesce(F.col("type") == F.col("physical_type"), F.lit(False))
        return both.select(*keys, F.coalesce("physical_type", F.lit("string")).alias("physical_type"), F.when(same, "string").otherwise(F.col("type")).alias("logical_type"))


def aggregate_rule(add: Callable[[object, pd.Series, pd.Series], object], merge: Callable[[object, object], object], finish: Callable[[object], str | None]) -> Rule:
    """A user's rule as an aggregate over a key's values, for any number of them.

    ``add(state, values, counts)`` takes some values into a state (None at first), ``merge`` makes one of two, ``finish`` gives the type, or None for no opinion.  States are made
    batch by batch where the values are, and only they are shuffled; so no key's values meet in one task, and a state should be small.
    """

    def rule(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
        kinds = dict(hist.dtypes)
        named = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
        plain = lambda x: None if pd.isna(x) else x

        def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(*map(plain, key), pickle.dumps(add(None, group["value"], group["cnt"]))) for key, group in batch.groupby(list(keys), dropna=False, sort=False)]
                yield pd.DataFrame(rows, columns=[*keys, "state"], dtype=object)

        def all_(group: pd.DataFrame) -> pd.DataFrame:
            state = functools.reduce(merge, map(pickle.loads, group["state"]))
            return pd.DataFrame([(*(plain(group[k].iloc[0]) for k in keys), finish(state))], columns=[*keys, "type"], dtype=object)

        states = hist.where("value is not null").select(*keys, "value", "cnt").mapInPandas(some, f"{named}, state binary")
        return states.groupBy(*keys).applyInPandas(all_, f"{named}, type string")

    return rule


def refresh(types: DataFrame, old: DataFrame, hist: DataFrame, keys: Sequence[str], infer: Infer = votes) -> DataFrame:
    """Types after a histogram grew from ``old`` to ``hist``: inferred anew only for keys whose number of different values has changed."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count_distinct("value").alias(name))
    changed = count(hist, "now_").join(count(old, "before_"), list(keys), "left").where("before_ is null or now_ <> before_").select(*keys)
    fresh = infer(hist.join(changed, list(keys), "left_semi"), keys)
    return types.join(changed, list(keys), "left_anti").select(*fresh.columns).unionByName(fresh)


def resolve_histogram(*sources: DataFrame | None) -> DataFrame:
    """The first histogram that there is, of a variable, of a parameter, or one that the caller carries along."""
    found = [x for x in sources if x is not None]
    if not found:
        raise ValueError("no histogram")
    return found[0]


def physical_rule(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    return votes(hist, keys).select(*keys, F.col("physical_type").alias("type"))


def logical_rule(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    return votes(hist, keys).select(*keys, F.col("logical_type").alias("type"))
