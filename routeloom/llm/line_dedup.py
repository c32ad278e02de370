"""Line deduplication by an exact set-similarity join, in DataFrame operations.

A line is the set of its words.  The words of a line are ordered by rarity, and two sets with a Jaccard likeness of at least
0.8 must share a word among the first ``n - ceil(0.8 n) + 1`` of each (prefix filter); their sizes (length filter), the places of
that word (positional filter) and the parities of 64 or 128 buckets of hashes over all their words bound the overlap further.  Pairs that
pass are verified on the words of the texts.  A line goes if an earlier line, in order of (doc_id, line number), has its set or
one that is similar.

Lines with equal sets are settled first, by a window that is cut before the shuffle, so only one line of each set goes on.
Groups of very many similar lines are settled without all their pairs: each line is verified against the first
and the last lines before it under a few of its words.  Lines that this did not settle are compared with all others, in one
join of the postings (one row for each prefix word of each line), in which the smaller set of a pair has the shorter prefix.

Texts are cut into words once; of each line 31 bits of each word's hash are held on the executors' disks until its rarest words are known.
Rarity comes from counts of the words of all lines, hashed into a table whose size grows with the corpus up to MOST_SLOTS;
words in one slot count together, which changes the order but nothing else: any one order for all lines gives exact results.
Inside the join a word is these 31 bits.  Equal sets are those with equal 128-bit hashes of their words' 64-bit hashes; pairs of
similar lines are held against each other word by word.

Behaviour on unusual input: lines without words stay; a null text stays null; a null doc_id comes after all others; rows
that repeat doc_id and text are one document and keep the same lines; further columns are kept; an empty table stays empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm._common import discard, is_small, keep, small_side, table, unused

#: White space in a line besides the blank, which blanks replace before words are cut.
SPACES = "\t\x0b\x0c\r"
#: Slots of the table of word counts: one for each WORDS_A_SLOT words of lines, in these bounds (eight bytes each for the tasks).
WORDS_A_SLOT, LEAST_SLOTS, MOST_SLOTS = 256, 1 << 14, 1 << 22
#: Words of a line's prefix under which it looks for a likely partner: those with the smallest hashes, so that similar lines agree in them.
FEW_WORDS = 3
#: Under each it looks at the first line and at so many of the last before it.
LAST_LINES = 1
LAST = (1 << 63) - 1
#: Bits of a word's hash inside the join.
KEY = (1 << 31) - 1
#: Lines of more words have parities of 128 buckets of hashes, others of 64.
LONG = 96
#: A line: its document's place in the order, its text's hash, and its number.
ID, OTHER = ["k", "t", "n"], ["ek", "et", "en"]


def _key(docs: DataFrame) -> list[Column]:
    """Place of a document in the order, and 64 bits of its text's hash: rows of one doc_id (null ids are one) are told apart by these."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("k"), F.xxhash64("text").alias("t")]


def _blanks(text: Column) -> Column:
    # Few texts have any; looking for bytes costs less than a pattern.
    found = reduce(Column.__or__, [text.contains(c) for c in SPACES])
    return F.when(found, F.translate(text, SPACES, " " * len(SPACES))).otherwise(text)


def _lines(text: Column) -> Column:
    """The lines of a text, with blanks for other white space; numbered like those of the text itself."""
    return F.split(_blanks(text), "\n")


def line_words(texts: DataFrame) -> DataFrame:
    """(k, t, n, size, one, two, keys) of each line with words: its set's size and hashes, and 31 bits of each of its words' hashes.

    Two words that share these bits stand there as two, which only makes more pairs to verify.
    """
    lines = texts.select("k", "t", F.posexplode(_lines(F.col("text"))).alias("n", "line")).where(F.trim("line") != "")
    hashes = F.array_distinct(F.expr("transform(split(line, ' '), w -> xxhash64(w))"))
    lines = lines.select(*ID, F.sort_array(F.array_remove(hashes, F.xxhash64(F.lit("")))).alias("set"))
    return lines.select(*ID, F.size("set").alias("size"), F.xxhash64("set").alias("one"), F.xxhash64(F.lit(1), "set").alias("two"), F.expr(f"transform(set, h -> cast(h & {KEY}L as int))").alias("keys"))


def rarity_levels(lines: DataFrame) -> tuple[Column, int]:
    """The levels of all slots (four to each doubling of the count, above 32 bits) as a scalar column, an array of longs, and the number of slots."""
    size = lines.agg(F.sum("size")).first()[0] or 0
    slots = min(max(1 << (size // WORDS_A_SLOT).bit_length(), LEAST_SLOTS), MOST_SLOTS)
    counts = lines.select(F.explode("keys").alias("w")).groupBy(F.expr(f"w & {slots - 1}").alias("slot")).count()
    level = F.least(F.floor(F.log2("count") * 4) + 1, F.lit(127)).cast("long")
    counts = keep(lines.sparkSession, counts.select("slot", F.shiftleft(level, 32).alias("level")))
    # At most MOST_SLOTS longs; a slot without words is level 0.
    every = lines.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot")).join(counts, "slot", "left")
    table_ = every.groupBy().agg(F.sort_array(F.collect_list(F.struct("slot", F.coalesce("level", F.lit(0).cast("long")).alias("level")))).alias("s"))
    # What was read back might hold nulls, and Spark sorts longs that may be null as objects; this says once that there are none.
    return keep(lines.sparkSession, table_.select(F.col("s.level").alias("levels"))).select(F.array_compact("levels")).scalar(), slots


def line_sets(lines: DataFrame, levels: Column, slots: int) -> DataFrame:
    """(k, t, n, size, one, two, p, q, prefix) of lines (k, t, n, size, one, two, keys): parities, and the keys of the rarest words in order of level, then key."""
    # Spark interprets what is done for each word, so it has few steps.
    code = f"transform(array(coalesce(levels, cast(array() as array<bigint>))), t -> transform(keys, h -> t[h & {slots - 1}] | h))[0]"
    lines = lines.select(*ID, "size", "one", "two", "keys", levels.alias("levels")).select(*ID, "size", "one", "two", "keys", F.sort_array(F.expr(code)).alias("rare"))
    # Words go to one of 64 buckets by their last six bits (a shift looks at no others); of long lines, whose 64 are mostly noise, a further bit makes it 128.
    parity = "aggregate(keys, 0L, (a, x) -> a ^ shiftleft({}, x))"
    more = f"if(size > {LONG}, {parity.format('cast((x >> 6) & 1 as bigint)')}, 0L)"
    rare = F.slice("rare", F.lit(1), F.col("size") - F.expr("(4 * size + 4) div 5").cast("int") + 1)
    return lines.select(*ID, "size", "one", "two", F.expr(parity.format("1L")).alias("p"), F.expr(more).alias("q"), F.transform(rare, lambda x: x.bitwiseAND(F.lit(KEY)).cast("int")).alias("prefix"))


def first_of_each_set(lines: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    # Spark cuts such a window before its shuffle as well, so a line that stands in a third of all documents goes there once a task.
    place = F.row_number().over(Window.partitionBy("one", "two", "size").orderBy(*ID))
    return lines.withColumn("place", place).where("place = 1").drop("place", "one", "two")


#: Conditions for two lines (size, p, q, and those with e): enough shared words are possible.
NEED = "((4 * (size + esize) + 8) div 9)"
DIFFER = f"if(size > {LONG} and esize > {LONG}, bit_count(q ^ eq) + bit_count((p ^ q) ^ (ep ^ eq)), bit_count(p ^ ep))"
FITS = f"4 * greatest(size, esize) <= 5 * least(size, esize) and {DIFFER} <= size + esize - 2 * {NEED}"


def likely_pairs(sets: DataFrame) -> DataFrame:
    """(k, t, n, ek, et, en): pairs of a line with the first one, and the last ones before it, under a few of its words, that may be similar."""
    from pyspark.sql import Window

    few = F.slice(F.sort_array("prefix"), 1, FEW_WORDS)
    posts = sets.select(*ID, "size", "p", "q", F.explode(few).alias("w"))
    before = Window.partitionBy("w").orderBy(*ID)
    line = F.struct(*[F.col(c).alias(e) for c, e in zip(ID, OTHER, strict=True)], F.col("size").alias("esize"), F.col("p").alias("ep"), F.col("q").alias("eq"))
    last = [F.lag(line, i).over(before).alias(f"last{i}") for i in range(1, LAST_LINES + 1)]
    posts = posts.select(*ID, "size", "p", "q", F.first(line).over(before.rowsBetween(Window.unboundedPreceding, 0)).alias("first"), *last)
    # A word's first line looks for nothing; the last of the lines before may be the first one once more.
    posts = posts.where("last1 is not null").select(*ID, "size", "p", "q", F.explode(F.array("first", *[f"last{i}" for i in range(1, LAST_LINES + 1)])).alias("e")).select(*ID, "size", "p", "q", "e.*")
    return posts.where(f"ek is not null and {FITS}").select(*ID, *OTHER).distinct()


def all_pairs(sets: DataFrame) -> DataFrame:
    """(k, t, n, ek, et, en): all pairs of lines that may be similar, whose later one has no ``settled``.

    The larger set of a pair has a shared word among its first ``n - ceil(0.8 n) + 1``, the smaller one among ``n - ceil(8 n / 9) + 1``.
    """
    # Size, place and whether the line is settled stand in one number, as these rows are most of what is shuffled.
    packed = F.expr("shiftleft(cast(size as bigint), 32) | shiftleft(cast(at as bigint), 1) | if(settled is null, 0, 1)")
    posts = lambda words: sets.select("id", "size", "p", "q", "settled", F.posexplode(words).alias("at", "w")).select("w", "id", packed.alias("sat"), "p", "q")
    small = posts(F.slice("prefix", F.lit(1), F.expr("size - (8 * size + 8) div 9 + 1").cast("int")))
    small = small.select(*[F.col(c).alias(f"e{c}") for c in small.columns])
    size, esize = "shiftright(sat, 32)", "shiftright(esat, 32)"
    place = lambda x: f"(shiftright({x}, 1) & 2147483647L)"
    order = f"({esize} < {size} or ({esize} = {size} and eid < id)) and (sat & esat & 1L) = 0"
    fits = FITS.replace("esize", "SMALL").replace("size", size).replace("SMALL", esize)
    places = f"least({size} - {place('sat')}, {esize} - {place('esat')}) >= " + NEED.replace("esize", "SMALL").replace("size", size).replace("SMALL", esize)
    spark = sets.sparkSession
    pairs = keep(spark, posts("prefix").join(small, F.expr(f"w = ew and {order} and {fits} and {places}")).select("id", "eid").distinct())
    # Few lines are in pairs, so their places are looked up once for both sides.
    ids = keep(spark, pairs.select("id").union(pairs.select("eid")).distinct())
    a = keep(spark, sets.select("id", *ID, "settled").join(small_side(ids), "id"))
    b = a.select(*[F.col(c).alias(f"e{c}") for c in a.columns])
    both = pairs.join(a, "id").join(b, "eid")
    swap = "(struct(ek, et, en) > struct(k, t, n))"
    turns = [(a, b, a) for a, b in (*zip(ID, OTHER, strict=True), ("settled", "esettled"))] + [(a, b, b) for a, b in zip(ID, OTHER, strict=True)]
    turned = both.select(*[F.expr(f"if({swap}, {b}, {a})" if to == a else f"if({swap}, {a}, {b})").alias(to) for a, b, to in turns])
    return turned.where("settled is null").drop("settled")


def words(line: Column) -> Column:
    """The set of a line's words."""
    return F.array_remove(F.array_distinct(F.split(line, " ")), "")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The later lines (k, t, n) of the pairs (k, t, n, ek, et, en) that are similar: 9 * overlap >= 4 * (size + size) is a likeness of 4/5."""
    other = [F.col(e).alias(c) for c, e in zip(ID, OTHER, strict=True)]
    ids = pairs.select(*ID).unionByName(pairs.select(*other))
    asked = keep(texts.sparkSession, ids.groupBy("k", "t").agg(F.collect_set("n").alias("asked")))
    found = texts.join(small_side(asked), ["k", "t"]).select("k", "t", "asked", _lines(F.col("text")).alias("lines"))
    found = found.select("k", "t", F.explode(F.expr("transform(asked, i -> struct(i as n, lines[i] as line))")).alias("x"))
    # Rows that repeat give their lines once more.
    lines = keep(texts.sparkSession, found.select("k", "t", "x.n", "x.line").distinct().withColumn("size", F.size(words(F.col("line")))))
    mine = [F.col(c).alias(e) for c, e in zip(ID, OTHER, strict=True)]
    both = pairs.select(*ID, *OTHER).join(lines, ID).join(lines.select(*mine, F.col("line").alias("other"), F.col("size").alias("esize")), OTHER)
    # Each line is cut once for a pair, as the words that both have are a set already.
    shared = F.size(F.array_remove(F.array_intersect(F.split("line", " "), F.split("other", " ")), ""))
    return both.where(shared * 9 >= (F.col("size") + F.col("esize")) * 4).select(*ID).distinct()


def lines_to_keep(docs: DataFrame) -> DataFrame:
    """(k, t, stays): numbers of the lines of a document that no earlier line equals or is similar to; lines without words are left out."""
    spark = docs.sparkSession
    texts = docs.where("text is not null").select(*_key(docs), "text")
    # Read twice; what an executor holds of it on its disk is made anew if it is lost.
    lines = line_words(texts).persist(StorageLevel.DISK_ONLY)
    sets = keep(spark, first_of_each_set(line_sets(lines, *rarity_levels(lines))).withColumn("id", F.monotonically_increasing_id()))
    lines.unpersist(blocking=True)
    likely = keep(spark, likely_pairs(sets))
    settled = keep(spark, verified(likely, texts))
    marked = sets.join(small_side(settled).withColumn("settled", F.lit(True)), ID, "left")
    # A join that shuffles all sets is made once.
    shuffled = [] if is_small(settled) else [keep(spark, marked)]
    marked = shuffled[0] if shuffled else marked
    pairs = keep(spark, all_pairs(marked))
    similar = keep(spark, verified(pairs, texts))
    left = sets.select(*ID).join(small_side(settled), ID, "left_anti").join(small_side(similar), ID, "left_anti")
    stays = keep(spark, left.groupBy("k", "t").agg(F.collect_list("n").alias("stays")))
    discard(sets, likely, settled, *shuffled, pairs, similar)
    return stays


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with text less its repeated and similar later lines, and n_lines, n_removed, emptied (it had words and has none left)."""
    docs = docs.drop("n_lines", "n_removed", "emptied")  # columns of these names are replaced
    k, t, stays, parts, gone = (unused(docs, x) for x in ("k", "t", "stays", "parts", "gone"))
    left = lines_to_keep(docs).select(F.col("k").alias(k), F.col("t").alias(t), F.col("stays").alias(stays))
    keyed = docs.select("*", _key(docs)[0].alias(k), _key(docs)[1].alias(t))
    # Line numbers are short beside the texts, which a join by hash needn't sort.
    out = keyed.join(left.hint("shuffle_hash"), [k, t], "left")
    # From the join alone, so that a filter on it, which Spark moves below the rest, does not cut texts into lines once more.
    emptied = F.col(stays).isNull() & F.coalesce(F.col("text").rlike(rf"[^ \n{SPACES}]"), F.lit(False))
    out = out.withColumn(gone, emptied).withColumn(parts, F.split("text", "\n"))
    blank = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.btrim(F.get(parts, i), F.lit(" " + SPACES)) == "")
    numbers = F.sort_array(F.array_union(F.coalesce(stays, F.array().cast("array<int>")), blank))
    out = out.withColumn(stays, numbers)
    kept = F.when(F.size(stays) >= F.size(parts), F.col("text")).otherwise(F.array_join(F.transform(stays, lambda i: F.get(parts, i)), "\n"))
    return out.select(
        *[kept.alias("text") if c == "text" else F.col(c) for c in docs.columns],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.when(F.col("text").isNotNull(), F.size(parts) - F.size(stays)).cast("long").alias("n_removed"),
        F.col(gone).alias("emptied"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
