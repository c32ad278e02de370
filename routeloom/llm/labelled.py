"""Labelled samples for the classifiers, and the fold that is held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many training rows of each label, those with the smallest hash of their id: what the driver gathers is bounded.
SAMPLE_PER_LABEL = 1500
#: And at most so many bytes of text, in the same order; a text that alone is longer is not learned from.
SAMPLE_BYTES = 64 << 20


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text (null: empty) leaves no remainder modulo 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_texts(docs: DataFrame, labels: DataFrame, label: str, per_label: int = SAMPLE_PER_LABEL, most_bytes: int = SAMPLE_BYTES) -> tuple[list[bytes], list[int], float]:
    """Texts and labels (0 or 1) of a bounded sample of the rows not held out, and the share of label 1 among all such rows."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    total = sum(counts.values())
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    picked = [known.where(F.col("label") == y).orderBy(*order).limit(per_label) for y in (0, 1)]
    ids = [(r["doc_id"], r["label"]) for part in picked for r in part.collect()]
    if not ids:
        return [], [], 0.5
    spark = docs.sparkSession
    # At most 2 * per_label ids: a bound on what is broadcast.
    wanted = F.broadcast(spark.createDataFrame(ids, "doc_id long, label int"))
    asked = docs.select("doc_id", "text").join(wanted, "doc_id")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    sizes = asked.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).orderBy(*order).collect()  # as many rows as ids
    fits, used = [], 0
    for r in sizes:
        if used + r["bytes"] <= most_bytes and r["n"] <= most_bytes >> 10:
            fits.append((r["doc_id"],))
            used += r["bytes"]
    if not fits:
        return [], [], 0.5
    wanted = F.broadcast(spark.createDataFrame(fits, "doc_id long"))
    rows = asked.join(wanted, "doc_id", "left_semi").orderBy("doc_id", "text").collect()  # at most ``most_bytes`` of text
    return [(r["text"] or "").encode("utf-8", "surrogatepass") for r in rows], [r["label"] for r in rows], counts.get(1, 0) / total
