"""Source divergence audit: how the words of the sources of one language differ.

Two passes over the texts.  The first finds the exact document frequency of every term and language; terms in enough documents are the
language's vocabulary.  The second recounts: the kept terms, padded with a delimiter on both sides, form an Aho-Corasick automaton
for each language, which runs over the texts, whose delimiters are blanks by then, and finds every occurrence.  Each group (language,
source) gives each kept term a share ``p`` of its occurrences, in smoothed integer arithmetic; the divergence of two groups is the sum
of the differences of their shares.

Counts stay sparse postings.  A term that a group hasn't got has the group's least share ``p0``, so a pair's sum splits into sums over the
terms of each group against the other's ``p0``, which follow from a histogram of the group's shares by running sums, and a correction for the terms that both
have, from a join of the postings by term.  No group is made dense, and nothing but one vocabulary shard at a time, of bounded size, passes
through the driver: vocabularies above ``SHARD_BYTES`` take one further run over the texts for each further shard.

Behaviour on unusual input: null text, lang and source are empty strings; each row is a document, repeated ones too; a language without kept
terms still has its pairs, of value 0; a source that is alone in its language has no pairs; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from routeloom.llm._common import discard, keep, table

LEAST_DOCS, SMOOTH, UNIT, TOP_TERMS = 30, 5, 1_000_000_000, 50
#: Bytes of padded terms in a shard of the vocabulary, which goes to every task and through the driver.
SHARD_BYTES = 2 << 20
#: Counts that a task holds before it gives them out, and characters of text that the automaton takes at once.
HELD, CHUNK = 400_000, 1 << 20

#: Bytes of terms are ASCII letters, lower-cased, and all that isn't ASCII; all others are delimiters.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normalised(text: bytes) -> bytes:
    """The text with terms in lower case and blanks for everything between them."""
    return text.translate(_TABLE)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, bytes]]:
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True)


def prepared(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(lang, term, docs): the number of documents of a language that hold a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, counts in found.items():
                data = [pa.array([lang] * len(counts), pa.string()), pa.array(counts.keys(), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())]
                yield pa.RecordBatch.from_arrays(data, names=["lang", "term", "docs"])
            found.clear()

        for lang, _, text in _rows(batches):
            found.setdefault(lang, Counter()).update(set(normalised(text).split()))
            if sum(map(len, found.values())) > HELD:
                yield from out()
        yield from out()

    return docs.mapInArrow(run, "lang string, term string, docs long").groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


def occurrences(docs: DataFrame, terms: list[tuple[str, str]]) -> DataFrame:
    """(lang, source, term, cnt) by task: occurrences of terms, given as (lang, term), in documents of their language."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)  # SHARD_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        words = [t for _, t in sent.value]
        numbers: dict[str, list[int]] = {}
        for i, (lang, _) in enumerate(sent.value):
            numbers.setdefault(lang, []).append(i)
        automata: dict[str, ahocorasick.Automaton] = {}
        found: dict[tuple[str, str], Counter] = {}
        waiting: dict[tuple[str, str], list[str]] = {}

        def automaton(lang: str) -> ahocorasick.Automaton:
            if lang not in automata:
                made = automata[lang] = ahocorasick.Automaton()
                for i in numbers[lang]:
                    made.add_word(f" {words[i]} ", i)
                made.make_automaton()
            return automata[lang]

        def count() -> None:
            for group, texts in waiting.items():
                found.setdefault(group, Counter()).update(map(itemgetter(1), automaton(group[0]).iter(f" {' '.join(texts)} ")))
            waiting.clear()

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in found.items():
                data = [pa.array([lang] * len(counts), pa.string()), pa.array([source] * len(counts), pa.string()), pa.array([words[i] for i in counts], pa.string()), pa.array(counts.values(), pa.int64())]
                yield pa.RecordBatch.from_arrays(data, names=["lang", "source", "term", "cnt"])
            found.clear()

        size = 0
        for lang, source, text in _rows(batches):
            if lang not in numbers:
                continue
            waiting.setdefault((lang, source), []).append(normalised(text).decode())
            size += len(text)
            if size > CHUNK:
                count()
                size = 0
                if sum(map(len, found.values())) > HELD:
                    yield from out()
        count()
        yield from out()

    return docs.mapInArrow(run, "lang string, source string, term string, cnt long")


def recount(docs: DataFrame, kept: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, source, term, cnt): occurrences of the kept terms (lang, term), from one run over the texts for each shard of them."""
    size = kept.agg(F.sum(F.octet_length("term") + F.octet_length("lang") + 2)).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    parts = []
    for i in range(shards):
        rows = kept.where(F.pmod(F.xxhash64("lang", "term"), F.lit(shards)) == i).select("lang", "term").collect()  # about ``shard_bytes``
        parts.append(occurrences(docs, [(r["lang"], r["term"]) for r in rows]))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.groupBy("lang", "source", "term").agg(F.sum("cnt").alias("cnt"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + SMOOTH) / (total + SMOOTH * terms)), exactly."""
    wide = lambda c: c.cast("decimal(28,0)")
    above, below = wide(count + SMOOTH) * F.lit(UNIT).cast("decimal(10,0)"), wide(total + terms * SMOOTH)
    return F.call_function("div", above, below) + 1


def _gap(a: str, b: str) -> Column:
    return F.abs(F.col(a) - F.col(b))


def against_least(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, other, apart): for each pair of groups, the first one's terms against the other's least share p0."""
    same = ["lang", "source"]
    shares = postings.groupBy(*same, F.col("p").alias("x")).agg(F.count("*").alias("n"))
    others = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("x"))
    asked = groups.select(*same).join(others, "lang").where("source <> other")
    # The histogram's rows have no ``other``; all sums are of counts and shares up to a row's own share.
    line = shares.withColumn("other", F.lit(None).cast("string")).unionByName(asked.withColumn("n", F.lit(0).cast("long")))
    upto = Window.partitionBy(*same).orderBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    line = line.select(*same, "other", "x", F.sum("n").over(upto).alias("n"), F.sum(F.col("n") * F.col("x")).over(upto).alias("s")).where("other is not null")
    ends = postings.groupBy(*same).agg(F.count("*").alias("terms"), F.sum("p").alias("sum_p"))
    out = line.join(ends, same, "left").na.fill(0, ["terms", "sum_p"])
    apart = F.col("x") * (F.col("n") * 2 - F.col("terms")) - F.col("s") * 2 + F.col("sum_p")
    return out.select(*same, "other", apart.alias("apart"))


def pair_values(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, other, value) of every ordered pair of sources of one language.

    postings: (lang, source, term, p) of terms that occur.  groups: (lang, source, terms, p0) with the number of terms of the vocabulary.
    """
    one = postings.join(groups.select("lang", "source", "p0"), ["lang", "source"])
    two = one.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    both = one.join(two, ["lang", "term"]).where("source < other")
    more = _gap("p", "q") - _gap("p", "q0") - _gap("p0", "q") + _gap("p0", "q0")
    shared = both.groupBy("lang", "source", "other").agg(F.sum(more).alias("shared"))
    shared = shared.unionByName(shared.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "shared"))
    half = against_least(postings, groups)
    back = half.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), F.col("apart").alias("back"))
    held = postings.groupBy("lang", "source").agg(F.count("*").alias("n"))
    ends = groups.join(held, ["lang", "source"], "left").na.fill(0, ["n"])
    ends_two = ends.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"), F.col("n").alias("m"))
    out = half.join(back, ["lang", "source", "other"]).join(shared, ["lang", "source", "other"], "left").join(ends, ["lang", "source"]).join(ends_two, ["lang", "other"])
    value = F.col("apart") + F.col("back") + F.coalesce("shared", F.lit(0)) + (F.col("terms") - F.col("n") - F.col("m")) * _gap("p0", "q0")
    return out.select("lang", "source", "other", F.when(F.col("terms") > 0, value).otherwise(0).cast("long").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank): every group's other sources by divergence, and its most overused terms."""
    spark = docs.sparkSession
    docs = prepared(docs)
    kept = keep(spark, document_frequencies(docs).where(F.col("docs") >= least_docs).select("lang", "term"))
    counts = keep(spark, recount(docs, kept, shard_bytes))
    terms = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("cnt").alias("total"))
    groups = docs.select("lang", "source").distinct().join(terms, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["terms", "total"])
    least = F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))).otherwise(0)
    groups = keep(spark, groups.withColumn("p0", least))
    placed = counts.join(groups.select("lang", "source", "terms", "total"), ["lang", "source"])
    postings = keep(spark, placed.select("lang", "source", "term", share(F.col("cnt"), F.col("total"), F.col("terms")).alias("p")))

    pairs = pair_values(postings, groups.select("lang", "source", "terms", "p0")).withColumnRenamed("other", "item").withColumn("part", F.lit("pair"))
    whole = counts.groupBy("lang", "term").agg(F.sum("cnt").alias("cnt"))
    sums = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("terms").alias("terms"))
    usual = whole.join(sums, "lang").select("lang", "term", share(F.col("cnt"), F.col("total"), F.col("terms")).alias("q"))
    over = postings.join(usual, ["lang", "term"]).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.select("lang", "source", "part", "item", "value", F.row_number().over(order).alias("rank"))
    out = keep(spark, ranked(pairs).unionByName(ranked(over).where(F.col("rank") <= top)))
    discard(kept, counts, groups, postings)
    return out


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
  FROM documents),
w AS (SELECT lang, source, id, unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(*) AS terms FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS cnt FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
n AS (SELECT lang, source, sum(cnt)::HUGEINT AS total FROM c GROUP BY lang, source),
s AS (
  SELECT g.lang, g.source, k.term, coalesce(cnt, 0) AS cnt,
    1 + (1000000000::HUGEINT * (coalesce(cnt, 0) + 5)) // (coalesce(total, 0) + 5 * terms) AS p
  FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang
  LEFT JOIN n ON n.lang = g.lang AND n.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
l AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (cnt + 5)) // (total + 5 * terms) AS q
  FROM (SELECT lang, term, sum(cnt)::HUGEINT AS cnt, sum(sum(cnt)) OVER (PARTITION BY lang) AS total FROM c GROUP BY lang, term) JOIN v USING (lang)),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM s AS a JOIN s AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
over_ AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM s JOIN l USING (lang, term) WHERE cnt > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM over_))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""
