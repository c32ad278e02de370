"""Many patterns at once: which of a parent's variables takes a segment.

Of all variables whose pattern finds the segment the first one takes it; those without a pattern, which take anything but static files, come after all that have
one.  A regular expression is tried only where something cheaper allows it: patterns that hold a literal (as those of prefixes and suffixes do) are
filed under three characters of it, segments are looked up under their own threes, and the length must allow a match.  Parents with few
variables need no such index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.functions.requests import variable_matches
from routeloom.sources.store import materialize

#: A parent with so many variables at most tries them all.
FEW = 4
#: Characters of a literal that variables are filed under.
GRAM = 3

#: Characters that stand for themselves in a pattern, escaped ones included, and what is sure to follow or come before a run of them.
_PLAIN = r"((?:[^\\.+*?()|\[\]{}^$]|\\[^A-Za-z0-9])*)"


def literal(pattern: Column) -> Column:
    """A text that any match of a pattern holds, the longer of its beginning and its end; empty if that can't be told."""
    clear = lambda x: F.regexp_replace(x, r"\\(.)", "$1")
    # A quantifier after a run, or an alternative anywhere, may leave the run out.
    sure = (pattern != "") & ~F.contains(pattern, F.lit("|"))
    head = clear(F.regexp_extract(pattern, rf"^\^?{_PLAIN}(?:\[|\(|\\[dw]|\$?\z)", 1))
    tail = clear(F.regexp_extract(pattern, rf"\]\+{_PLAIN}\$?\z", 1))
    return F.when(sure, F.when(F.length(head) >= F.length(tail), head).otherwise(tail)).otherwise("")


def grams(text: Column) -> Column:
    """The different runs of GRAM characters of a text."""
    last = F.length(text) - GRAM + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def match(segments: DataFrame, variables: DataFrame, few: int = FEW) -> DataFrame:
    """(parent, segment, variable): the variable that takes each segment; segments that none takes are left out.

    segments: (parent, segment).  variables: (parent, variable, pattern, first_seq); a null pattern is none, equal first_seq go by name and pattern.  Nulls
    in parent or segment match nothing; rows that repeat count once; further columns are ignored.
    """
    # Both are read several times below, and may be dear to make.
    asked = materialize(segments.select("parent", "segment").distinct())
    known = materialize(variables.select("parent", "variable", F.coalesce("pattern", F.lit("")).alias("pattern"), "first_seq"))
    order = F.struct((F.col("pattern") == "").alias("open"), "first_seq", "variable", "pattern")
    filed = known.withColumns({"literal": literal(F.col("pattern")), "order": order})
    crowded = known.groupBy("parent").count().where(F.col("count") > few).select(F.col("parent").alias("of_"))
    crowded_here = filed.join(crowded, F.col("parent") == F.col("of_"), "left_semi")
    under = (F.length("literal") >= GRAM).alias("filed")
    indexed = crowded_here.where(under).withColumn("gram", F.substring("literal", 1, GRAM))
    plain = filed.join(crowded, F.col("parent") == F.col("of_"), "left_anti").unionByName(crowded_here.where(~under))
    fits = (F.octet_length("segment") >= F.octet_length("literal")) & (F.contains(F.col("segment"), F.col("literal"))) & variable_matches(F.col("segment"), F.col("pattern"))
    # Only segments of parents with an index are cut.
    cut = asked.join(crowded, F.col("parent") == F.col("of_"), "left_semi").select("parent", "segment", F.explode(grams(F.col("segment"))).alias("gram"))
    found = cut.join(indexed, ["parent", "gram"]).where(fits).select("parent", "segment", "order")
    found = found.unionByName(asked.join(plain, "parent").where(fits).select("parent", "segment", "order"))
    return found.groupBy("parent", "segment").agg(F.min("order").alias("o")).select("parent", "segment", F.col("o.variable").alias("variable"), F.col("o.pattern").alias("pattern"))
