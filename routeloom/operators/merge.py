"""Sibling merging: which segments under one parent are values of a path variable.

``evaluate`` looks once at the whole set of siblings of each parent, with aggregates only.  ``replay`` follows the order of
arrival, in which an early merge absorbs later segments; it needs one ordered pass for each parent and so runs in
``applyInPandas``, over distinct segments only, of which just the first ``HEAD`` of a parent, and what its first variable doesn't
absorb, reach the pass.
"""

from __future__ import annotations

import heapq
import os.path
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routeloom.functions.patterns import SIBLING_PATTERNS, STATIC_EXTENSIONS, VARIABLE_REGEX, VARIABLE_SUFFIX
from routeloom.functions.requests import variable_matches
from routeloom.sources.store import materialize

MERGE, SKIP, DEFAULT = "merge", "skip", "default"
HEAD = 10_000


@dataclass(frozen=True)
class MergeConfig:
    """Thresholds; out-of-range values are drawn to the nearest sound one."""

    sibling_merge_threshold: int = 3
    pattern_similarity_threshold: float = 0.6
    similar_length_break_threshold: int = 6
    required_param_threshold: float = 0.9
    selective_only: bool = False

    def __post_init__(self) -> None:
        put = lambda k, v: object.__setattr__(self, k, v)
        put("sibling_merge_threshold", max(2, self.sibling_merge_threshold))
        put("pattern_similarity_threshold", min(1.0, max(0.0, self.pattern_similarity_threshold)))
        put("required_param_threshold", self.required_param_threshold if self.required_param_threshold > 0 else 0.9)


#: (parent's name, segments in order, pattern, share, config) to (MERGE, SKIP or DEFAULT, segments to merge).
Rule = Callable[[str, list[str], str, float, MergeConfig], tuple[str, list[str]]]


def common_prefix(a: Column, b: Column) -> Column:
    """The longest common prefix of two strings; of a set it is that of its smallest and largest."""
    # The place of the first pair of characters that differ.
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(pairs, False)
    return F.when(a == b, a).otherwise(F.substring(a, F.lit(1), F.greatest(first - 1, F.lit(0)).cast("int")))


def _number_or_code(v: Column) -> Column:
    return (F.length(v) > 0) & (v.rlike(r"^[+-]?[0-9]*\z") | (v.rlike(r"^[A-Za-z0-9]+\z") & v.rlike("[A-Za-z]") & v.rlike("[0-9]")))


def quote(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\.+*?()|\[\]{}^$])", r"\\$1")


_BIT = {k: 1 << i for i, k in enumerate(SIBLING_PATTERNS)}


def with_patterns(siblings: DataFrame) -> DataFrame:
    """Siblings with mask: a bit for each pattern that the segment fits, so that each is tried once."""
    if "mask" in siblings.columns:
        return siblings
    return siblings.withColumn("mask", sum((F.when(F.col("segment").rlike(p), _BIT[k]).otherwise(0) for k, p in SIBLING_PATTERNS.items()), F.lit(0)))


def detect(siblings: DataFrame) -> DataFrame:
    """(parent, n, pattern, hits, prefix, suffix) from distinct (parent, segment)."""
    s = F.col("segment")
    siblings = with_patterns(siblings)
    sums = siblings.groupBy("parent").agg(
        F.count("*").alias("n"), F.min("segment").alias("lo"), F.max("segment").alias("hi"), F.min(F.reverse(s)).alias("rlo"), F.max(F.reverse(s)).alias("rhi"),
        F.floor(F.avg(F.octet_length("segment"))).alias("mean_bytes"), *[F.count_if(F.col("mask").bitwiseAND(F.lit(b)) != 0).alias(f"m_{k}") for k, b in _BIT.items()],
    )
    sums = sums.withColumn("prefix", F.regexp_replace(common_prefix(F.col("lo"), F.col("hi")), r"[0-9]+\z", ""))
    sums = sums.withColumn("suffix", F.regexp_replace(F.reverse(common_prefix(F.col("rlo"), F.col("rhi"))), r"^[0-9]+", ""))
    near = siblings.join(sums.select("parent", "prefix", "suffix", "mean_bytes"), "parent")
    after = F.when(F.col("prefix") != "", F.substring(s, F.length("prefix") + 1, F.length(s))).otherwise("")
    before = F.when(F.col("suffix") != "", F.substring(s, F.lit(1), F.length(s) - F.length("suffix"))).otherwise("")
    more = near.groupBy("parent").agg(
        F.count_if(_number_or_code(after)).alias("m_prefix"), F.count_if(_number_or_code(before)).alias("m_suffix"),
        F.count_if(F.abs(F.octet_length("segment") - F.col("mean_bytes")) <= 2).alias("m_similar"),
    )
    named = sums.join(more, "parent").withColumn("best", F.greatest(*[F.col(f"m_{k}") for k in SIBLING_PATTERNS]))
    best, n = F.col("best"), F.col("n")
    weak = best * 2 < n
    affix = lambda k: weak & (n >= 3) & (F.col(f"m_{k}") * 10 >= n * 6)
    fallback = F.when(affix("prefix"), "prefix").when(affix("suffix"), "suffix").when(weak & (F.col("m_similar") * 10 >= n * 8), "similar_length_strings")
    own = F.coalesce(*[F.when((F.col(f"m_{k}") == best) & (best > 0), k) for k in SIBLING_PATTERNS], F.lit(""))
    chosen = named.withColumn("fallback", fallback).withColumn("pattern", F.coalesce("fallback", own))
    f = F.col("fallback")
    hits = F.when(f == "prefix", F.col("m_prefix")).when(f == "suffix", F.col("m_suffix")).when(f.isNotNull(), F.col("m_similar")).otherwise(best)
    return chosen.select("parent", "n", "pattern", hits.alias("hits"), "prefix", "suffix")


def parent_name(parent: Column) -> Column:
    """The last segment of a route, without braces; the root is called root."""
    last = F.regexp_replace(F.element_at(F.split(parent, "/"), -1), r"^\{|\}\z", "")
    return F.when(last == "", "root").otherwise(last)


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def variable_name(pattern: Column, name: Column, prefix: Column, suffix: Column) -> Column:
    out = F.coalesce(F.concat(name, F.lit("_"), F.try_element_at(_literal_map(VARIABLE_SUFFIX), pattern)), F.concat(F.lit("var_"), name))
    base = lambda x, trim: F.when(F.regexp_replace(x, trim, "") == "", name).otherwise(F.regexp_replace(x, trim, ""))
    return F.when(pattern == "prefix", F.concat(base(prefix, r"[_.-]+\z"), F.lit("_id"))).when(pattern == "suffix", F.concat(base(suffix, r"^[_.-]+"), F.lit("_id"))).otherwise(out)


def variable_regex(pattern: Column, prefix: Column, suffix: Column) -> Column:
    out = F.coalesce(F.try_element_at(_literal_map(VARIABLE_REGEX), pattern), F.lit(""))
    return F.when(pattern == "prefix", F.concat(quote(prefix), F.lit("[0-9]+"))).when(pattern == "suffix", F.concat(F.lit("[0-9]+"), quote(suffix))).otherwise(out)


def fits(pattern: Column, mask: Column) -> Column:
    """Whether a segment, by its mask, fits the pattern of its siblings."""
    bits = F.create_map(*[F.lit(x) for kv in _BIT.items() for x in kv])
    return F.coalesce(F.try_element_at(bits, pattern), F.lit(0)).bitwiseAND(mask) != 0


def decide(siblings: DataFrame, config: MergeConfig = MergeConfig(), whatever: bool = False) -> DataFrame:
    """(parent, n, pattern, hits, action, variable, regex): action is all, some or none, which has no variable unless ``whatever``."""
    p, n = F.col("pattern"), F.col("n")
    strong = F.col("hits") * 10 >= n * 8
    some = F.when(F.col("hits") >= 3, "some").otherwise("none")
    similar = (n >= config.similar_length_break_threshold) if config.similar_length_break_threshold > 0 else F.lit(False)
    whole = some if config.selective_only else F.lit("all")
    action = (
        F.when(n < config.sibling_merge_threshold, "none")
        .when(p == "similar_length_strings", F.when(similar, "all").otherwise("none"))
        .when(p.isin("prefix", "suffix"), "all")
        .when(strong, F.when(n >= 3, whole).otherwise("none"))
        .otherwise(some)
    )
    # A parent's name is read by several expressions, and so computed before them.
    found = detect(siblings).withColumn("name", parent_name(F.col("parent")))
    merged = action != "none"
    variable, regex = variable_name(p, F.col("name"), F.col("prefix"), F.col("suffix")), variable_regex(p, F.col("prefix"), F.col("suffix"))
    if whatever:
        return found.select("parent", "n", "pattern", "hits", action.alias("action"), variable.alias("variable"), regex.alias("regex"))
    return found.select("parent", "n", "pattern", "hits", action.alias("action"), F.when(merged, variable).alias("variable"), F.when(merged, regex).alias("regex"))


def evaluate(siblings: DataFrame, config: MergeConfig = MergeConfig(), rule: Rule | None = None) -> DataFrame:
    """(parent, segment, variable, regex): variable is null for segments that stay fixed.

    A rule sees all segments of a parent at once, so with one they meet in one task; without, all is aggregates.
    """
    siblings = with_patterns(siblings)
    choice = decide(siblings, config, whatever=rule is not None)
    both = siblings.join(choice.withColumnRenamed("n", "n_").select("parent", "pattern", "action", "variable", "regex", "hits", "n_"), "parent")
    merged = (F.col("action") == "all") | ((F.col("action") == "some") & fits(F.col("pattern"), F.col("mask")))
    if rule is None:
        return both.select("parent", "segment", F.when(merged, F.col("variable")).alias("variable"), F.when(merged, F.col("regex")).alias("regex"))

    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["first_seq", "segment"])
        top = rows.iloc[0]
        out = rows["merged"].to_numpy()
        if len(rows) >= config.sibling_merge_threshold:
            action, chosen = rule(name_of(top["parent"]), list(rows["segment"]), top["pattern"], top["hits"] / top["n_"], config)
            if action == SKIP:
                out = out & False
            elif action == MERGE:
                out = rows["segment"].isin(set(chosen)).to_numpy()
            if out.sum() < 3:
                out = out & False
        return pd.DataFrame({"parent": rows["parent"], "segment": rows["segment"], "variable": rows["variable"].where(out), "regex": rows["regex"].where(out)})

    order = F.col("first_seq") if "first_seq" in siblings.columns else F.lit(0).cast("long")
    rows = both.select("parent", "segment", "pattern", "hits", "n_", "variable", "regex", merged.alias("merged"), order.alias("first_seq"))
    return rows.groupBy("parent").applyInPandas(ask, "parent string, segment string, variable string, regex string")


# --- replay in order of arrival -----------------------------------------------------------------------------------------------

_PY = {k: re.compile(v.replace(r"\z", r"\Z").replace(r"\p{IsHan}", "[⺀-⿟々〇〡-〩〸-〻㐀-䶿一-鿿豈-﫿]"), re.ASCII) for k, v in SIBLING_PATTERNS.items()}


def _affixes(values: list[str]) -> tuple[str, str]:
    """The common prefix and suffix of values, without the digits at their inner ends."""
    return re.sub(r"[0-9]+\Z", "", os.path.commonprefix(values)), re.sub(r"\A[0-9]+", "", os.path.commonprefix([v[::-1] for v in values])[::-1])


class _Last(str):
    """A string whose order is turned round, for a heap with the largest one on top."""

    __slots__ = ()

    def __lt__(self, other: str) -> bool:
        return str.__gt__(self, other)


class _Affix:
    """The common prefix (or suffix) of a set that grows and shrinks, and how many of its members go on from it with a number or a code.

    The common prefix of a set is that of its least and its largest member, which heaps have on top once members that are gone
    are popped.  The members are counted anew only when the affix changes; while the set grows, it only gets shorter.
    """

    def __init__(self, members: dict[str, None], tail: bool):
        self.members, self.tail = members, tail
        self.least: list[str] = []
        self.most: list[_Last] = []
        self.affix, self.good = "", 0

    def fits(self, v: str) -> bool:
        rest = v[: len(v) - len(self.affix)] if self.tail else v[len(self.affix) :]
        return len(v) > len(self.affix) and (re.fullmatch(r"[+-]?[0-9]*", rest) is not None or re.fullmatch(r"[A-Za-z0-9]+", rest) is not None and re.search("[A-Za-z]", rest) is not None and re.search("[0-9]", rest) is not None)

    def add(self, v: str) -> None:
        key = v[::-1] if self.tail else v
        heapq.heappush(self.least, key)
        heapq.heappush(self.most, _Last(key))
        self.good += bool(self.affix) and self.fits(v)

    def remove(self, v: str) -> None:
        self.good -= bool(self.affix) and self.fits(v)

    def share(self) -> float:
        for heap in (self.least, self.most):
            while heap and str(heap[0][::-1] if self.tail else heap[0]) not in self.members:
                heapq.heappop(heap)
        if len(self.members) < 3:
            return 0.0
        ends = [str(self.least[0]), str(self.most[0])]
        affix = _affixes([x[::-1] for x in ends])[1] if self.tail else _affixes(ends)[0]
        if affix != self.affix:
            self.affix = affix
            self.good = sum(map(self.fits, self.members)) if affix else 0
        return self.good / len(self.members)


class Siblings:
    """The fixed children and variables of one parent, fed one new segment at a time.

    Each segment costs a few steps, whatever the number of siblings: what decides on a merge is kept up to date as segments come and go.  Only a
    user's rule is given all fixed siblings each time.
    """

    def __init__(self, name: str, config: MergeConfig, rule: Rule | None = None):
        self.name, self.config, self.rule = name, config, rule
        self.fixed: dict[str, None] = {}  # in order of arrival
        self.matched: dict[str, list[str]] = {}
        self.members: dict[str, dict[str, None]] = {k: {} for k in SIBLING_PATTERNS}
        self.ends = {"prefix": _Affix(self.fixed, False), "suffix": _Affix(self.fixed, True)}
        self.sizes: Counter[int] = Counter()
        self.bytes = 0
        self.variables: list[tuple[str, str]] = []
        self.role: dict[str, tuple[str, str] | None] = {}
        self.merged: set[str] = set()

    def forget_absorbed(self) -> None:
        """Drop the roles of segments that a variable has absorbed: it would do so again."""
        self.role = {s: v for s, v in self.role.items() if v is None or s in self.merged}

    def absorbs(self, segment: str) -> bool:
        if not self.variables or segment in ("", "/"):
            return False
        pattern = self.variables[0][1]
        if not pattern:
            return not segment.lower().endswith(STATIC_EXTENSIONS)
        return re.search(pattern.replace(r"\p{IsHan}", "一-鿿"), segment, re.ASCII) is not None

    def detect(self) -> tuple[str, float]:
        n = len(self.fixed)
        best = max(map(len, self.members.values()))
        name = next(k for k, v in self.members.items() if len(v) == best) if best else ""
        if best * 2 < n:
            for kind, ends in self.ends.items():
                share = ends.share()
                if share >= 0.6:
                    return kind, share
            mean = self.bytes // n
            share = sum(self.sizes[mean + d] for d in range(-2, 3)) / n
            if share >= 0.8:
                return "similar_length_strings", share
        return name, best / n

    def choose(self) -> tuple[list[str], str]:
        pattern, share = self.detect()
        if self.rule:
            action, chosen = self.rule(self.name, list(self.fixed), pattern, share, self.config)
            if action == SKIP:
                return [], pattern
            if action == MERGE:
                wanted = set(chosen)
                return [v for v in self.fixed if v in wanted], pattern
        if pattern == "similar_length_strings":
            least = self.config.similar_length_break_threshold
            return (list(self.fixed) if 0 < least <= len(self.fixed) else []), pattern
        if pattern in ("prefix", "suffix") or share >= 0.8 and not self.config.selective_only:
            return list(self.fixed), pattern
        # Members of a pattern are in order of arrival as well.
        return list(self.members.get(pattern, {})), pattern

    def variable(self, pattern: str, values: list[str]) -> tuple[str, str]:
        if pattern in ("prefix", "suffix"):
            affix = _affixes(values)[pattern == "suffix"]
            base = re.sub(r"[_.-]+\Z", "", affix) if pattern == "prefix" else re.sub(r"\A[_.-]+", "", affix)
            regex = "" if not affix else re.sub(r"([\\.+*?()|\[\]{}^$])", r"\\\1", affix)
            regex = regex and (regex + "[0-9]+" if pattern == "prefix" else "[0-9]+" + regex)
            return f"{base or self.name}_id", regex
        kind = VARIABLE_SUFFIX.get(pattern)
        return (f"{self.name}_{kind}" if kind else f"var_{self.name}"), VARIABLE_REGEX.get(pattern, "")

    def _add(self, segment: str) -> None:
        self.fixed[segment] = None
        self.matched[segment] = [k for k, p in _PY.items() if p.search(segment)]
        for k in self.matched[segment]:
            self.members[k][segment] = None
        for ends in self.ends.values():
            ends.add(segment)
        size = len(segment.encode())
        self.sizes[size] += 1
        self.bytes += size

    def _remove(self, segment: str) -> None:
        del self.fixed[segment]
        for k in self.matched.pop(segment):
            del self.members[k][segment]
        for ends in self.ends.values():
            ends.remove(segment)
        size = len(segment.encode())
        self.sizes[size] -= 1
        self.bytes -= size

    def feed(self, segment: str) -> None:
        if segment in self.role:
            return
        if self.absorbs(segment):
            self.role[segment] = self.variables[0]
            return
        self.role[segment] = None
        self._add(segment)
        if len(self.fixed) < self.config.sibling_merge_threshold:
            return
        chosen, pattern = self.choose()
        if len(chosen) < 3:
            return
        made = self.variable(pattern, chosen)
        self.variables.append(made)
        self.merged.update(chosen)
        for v in chosen:
            self.role[v] = made
            self._remove(v)


def name_of(parent: str) -> str:
    last = parent.rsplit("/", 1)[-1]
    last = last[1:-1] if last.startswith("{") and last.endswith("}") else last
    return last or "root"


def replay(siblings: DataFrame, config: MergeConfig = MergeConfig(), rule: Rule | None = None, head: int = HEAD) -> DataFrame:
    """(parent, segment, variable, regex) from distinct (parent, segment, first_seq), decided in order of first_seq."""
    schema = "parent string, segment string, variable string, regex string, made int"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["first_seq", "segment"])
        parent = rows["parent"].iloc[0]
        state = Siblings(name_of(parent), config, rule)
        for s in rows["segment"]:
            state.feed(s)
        made = {v: i for i, v in reversed(list(enumerate(state.variables)))}
        out = [(parent, s, *(v or (None, None)), made.get(v)) for s, v in state.role.items()]
        return pd.DataFrame(out, columns=["parent", "segment", "variable", "regex", "made"])

    # Spark keeps only the head of each parent before the window; what comes after its last segment is told by comparison.
    order = Window.partitionBy("parent").orderBy("first_seq", "segment")
    place = F.struct("first_seq", "segment")
    ranked = materialize(siblings.select("parent", "segment", "first_seq").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= head))
    ends = ranked.where(F.col("rank") == head).select(F.col("parent").alias("p_"), place.alias("end_"))
    first = materialize(ranked.select("parent", "segment", "first_seq").groupBy("parent").applyInPandas(run, schema))
    # The variable made first takes whatever it matches among the later segments, which changes nothing else in the state.
    lead = first.where("made = 0").groupBy("parent").agg(F.first(F.struct("variable", "regex")).alias("v"))
    later = siblings.join(ends, F.col("parent") == F.col("p_")).where(place > F.col("end_")).select("parent", "segment", "first_seq")
    rest = later.join(lead, "parent", "left").select("parent", "segment", "first_seq", "v.variable", "v.regex")
    taken = F.col("variable").isNotNull() & variable_matches(F.col("segment"), F.col("regex"))
    absorbed = rest.where(taken).select("parent", "segment", "variable", "regex")
    open_ = materialize(rest.where(~F.coalesce(taken, F.lit(False))).select("parent", "segment", "first_seq"))
    # The others go on from the state at the head's end, so the head is fed again before them.
    again = open_.select("parent").distinct()
    fed = siblings.select("parent", "segment", "first_seq").join(first.select("parent", "segment"), ["parent", "segment"], "left_semi").join(again, "parent", "left_semi")
    late = open_.unionByName(fed).groupBy("parent").applyInPandas(run, schema)
    columns = ["parent", "segment", "variable", "regex"]
    return first.join(again, "parent", "left_anti").select(*columns).unionByName(absorbed).unionByName(late.select(*columns))
