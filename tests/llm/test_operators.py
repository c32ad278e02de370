"""Each operator against a brute-force version, on rows with all the usual oddities, and on empty tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from routeloom.llm import additive_ann, line_dedup, lz_fingerprint, mixing, packing, quality, simhash, substring, toxicity, warc_zip
from routeloom.llm._common import word_count


def pairs_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def without_windows(rows, seen_before=()):
    """Kept texts of (doc_id, text): windows that a smaller doc_id has, or that are in seen_before."""
    order = lambda d: substring.NULL_ID if d is None else d
    first = {}
    for d, x in rows:
        w = (x or "").encode().split()
        for i in range(len(w) - 12):
            key = tuple(w[i : i + 13])
            first[key] = min(first.get(key, order(d)), order(d))
    out = []
    for d, x in rows:
        w = (x or "").encode().split()
        gone = set()
        for i in range(len(w) - 12):
            key = tuple(w[i : i + 13])
            if first[key] < order(d) or key in seen_before:
                gone.update(range(i, i + 13))
        out.append((d, len(w), len(gone), b" ".join(a for i, a in enumerate(w) if i not in gone).decode()))
    return out


def as_rows(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def test_op1_against_brute_force(odd_docs, empty_docs):
    got = as_rows(substring.dedup(odd_docs), "doc_id", "n_words", "n_removed", "kept_text")
    assert got == Counter(without_windows(pairs_of(odd_docs)))
    assert sum(n for (_, _, gone, _), n in got.items() if gone) > 20
    assert substring.dedup(empty_docs).count() == 0


def test_op1_run_encoding():
    h = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    tag, own, ids = h % np.uint64(65521), np.arange(5000) % 7, np.arange(7) * 10**12
    a, b, c = substring.decode_run(substring.encode_run(h, tag, own, ids))
    assert (a == h).all() and (b == tag).all() and (c == ids[own]).all()
    assert substring.decode_run(substring.encode_run(h, tag, None, None))[2] is None


def test_op1_tags_decide(odd_docs):
    h = np.array([5, 5, 9, 9, 11], np.uint64)
    tag = np.array([1, 2, 1, 3, 1], np.uint64)
    marked, tags = np.array([9, 5, 5, 9], np.uint64), np.array([3, 2, 2, 7], np.uint64)
    assert substring._in_both(h, tag, marked, tags).tolist() == [False, True, False, True, False]
    wide = as_rows(substring.dedup(odd_docs, tag_bytes=8), "doc_id", "n_words", "n_removed", "kept_text")
    assert wide == Counter(without_windows(pairs_of(odd_docs)))
    assert substring.WindowHasher(tag_bytes=8)([b"w " * 20])[1].max() > 1 << 56


def test_op1_index_over_batches(spark, odd_docs, tmp_path):
    docs = odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = sorted(pairs_of(docs))
    index = substring.FingerprintIndex(spark, f"file://{tmp_path}/index", parts=3, levels=1)
    seen = set()
    for low, high in ((0, 105), (105, 305), (305, 600)):
        batch = [r for r in rows if low <= r[0] < high]
        got = as_rows(index.add(docs.where(F.col("doc_id").between(low, high - 1))), "doc_id", "n_words", "n_removed", "kept_text")
        assert got == Counter(without_windows(batch, seen))
        for _, x in batch:
            w = (x or "").encode().split()
            seen.update(tuple(w[i : i + 13]) for i in range(len(w) - 12))
    assert len(index._generations()) <= 2


def test_op1_in_batches(spark, odd_docs, empty_docs, monkeypatch):
    """The registered query's way: batches by doc_id, with a history and a compaction, give what one batch does."""
    compacted = []
    compact = substring.FingerprintIndex.compact
    monkeypatch.setattr(substring.FingerprintIndex, "compact", lambda self: compacted.append(len(self._generations())) or compact(self))
    got = as_rows(substring.dedup_in_batches(odd_docs), "doc_id", "n_words", "n_removed", "kept_text")
    assert got == Counter(without_windows(pairs_of(odd_docs))) and compacted == [2]
    digests = as_rows(substring.dedup_in_batches(odd_docs, batches=2, digest=True), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert digests == Counter((d, n, gone, hashlib.sha256(x.encode()).hexdigest()) for d, n, gone, x in got.elements())
    assert substring.dedup_in_batches(empty_docs).count() == 0
    one = spark.createDataFrame([(7, "a b c d e f g h i j k l m n"), (7, "a b c d e f g h i j k l m n"), (None, "x a b c d e f g h i j k l m")], "doc_id long, text string")
    assert as_rows(substring.dedup_in_batches(one), "doc_id", "n_removed") == Counter({(7, 0): 2, (None, 13): 1})


class _Task:
    """Stands for a DataFrame: mapInArrow gives what runs in a task."""

    def __getattr__(self, name):
        return lambda *a, **b: self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def test_op1_memory_of_a_task(spark):
    """Two workers have to fit beside an executor's heap: runs and merges hold far less than all arrays of a range at once."""
    import tracemalloc

    import pyarrow as pa

    rng, schema = np.random.default_rng(3), pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    documents = lambda first: (pa.RecordBatch.from_arrays([pa.array(range(i, i + 50)), pa.array([" ".join(map(str, rng.integers(0, 10**5, 1000).tolist())) for _ in range(50)])], schema=schema) for i in range(first, first + 2000, 50))

    def peak(run, batches):
        tracemalloc.start()
        try:
            out = [x for b in run(batches) for x in b.to_pylist()]
            return out, tracemalloc.get_traced_memory()[1] - sum(len(x["data"]) for x in out)
        finally:
            tracemalloc.stop()

    build, merge, index = substring.build_runs(_Task(), 1), substring.merge_runs(_Task(), 1), substring.merge_runs(_Task(), 1, index=True)
    runs, most = peak(build, documents(0))
    assert most < 130e6
    more, _ = peak(build, documents(2000))
    h, tag, _ = substring.decode_run(runs[0]["data"])
    more.append(runs[0] | {"data": substring.encode_run(h, tag, np.zeros(len(h), np.int64), np.array([9999]))})  # windows that a smaller doc_id has
    rows = lambda r: iter([pa.RecordBatch.from_pylist([x], schema=pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("data", pa.binary())])) for x in r])
    marks, most = peak(merge, rows(runs + more))
    assert most < 170e6 and {x["kind"] for x in marks} == {substring.RUN}
    levels, most = peak(index, rows(runs + more))
    assert most < 170e6
    h = np.concatenate([substring.decode_run(x["data"])[0] for x in levels])
    every = np.unique(np.concatenate([substring.decode_run(x["data"])[0] for x in runs + more]))
    assert (h == every).all()  # in order, each once


def test_op2_against_the_tokenizer(odd_docs, empty_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for d, x in pairs_of(odd_docs):
        ids = [*whole.encode(x or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want.update((d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    pieces = packing.token_pieces(odd_docs)
    assert as_rows(pieces, "doc_id", "piece", "start", "length", "ids_crc32") == want
    rows = packing.pack(pieces, task_items=4).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        ends = np.cumsum([n for _, n in sorted(b)])
        assert ends[-1] <= 1024 and [o for o, _ in sorted(b)] == [0, *ends[:-1]]
    assert len(bins) <= -(-sum(r["length"] for r in rows) // 1024) + 1
    assert packing.pack(packing.token_pieces(empty_docs)).count() == 0


@pytest.mark.parametrize("text", ["a  b", " a", "a ", "a\n\nb c\td", "it's  \n x y z\x1cq r", "你好 世界\n再见", "don't 12 !!", "", " ", "\n"])
def test_op2_chunks_are_exact(text):
    import public_tokenizers

    encoder = packing.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == want


def test_op2_merges_what_is_left_in_rounds(spark):
    # In each of 16 partitions 20 pieces that nothing fits with, and a small one: all small ones together fill two sequences.
    sizes = [1000 if i % 21 else 100 for i in range(16 * 21)]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = spark.createDataFrame(spark.sparkContext.parallelize([(i, 0, 0, n, 0) for i, n in enumerate(sizes)], 16), schema)
    rows = packing.pack(pieces, task_items=10).collect()
    assert len(rows) == len(sizes) and len({r["sequence_id"] for r in rows}) == 320 + 2


def test_op2_partitions_without_rows(spark):
    pieces = spark.createDataFrame([(i, 0, 0, 500, 7) for i in range(4)], packing.PIECE).repartition(6)
    assert len({r["sequence_id"] for r in packing.pack(pieces).collect()}) == 2


def test_op2_reads_the_end_mark_as_its_token():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    whole, encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    texts = ["a<|endoftext|> b"] + ["".join(rng.choice(["<|endoftext|>", " ", "\n", "  ", "\t", "a", "it's", "12", "!", "<|", "你"]) for _ in range(9)) for _ in range(2000)]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("zip64", [False, True])
def test_op3_round_trip(spark, tmp_path, zip64):
    rows = [(3, "http://a/ü", "same"), (1, None, "same"), (2, "u", None), (5, "u", ""), (7, "u", "<html>\r\n\r\nX 你</html>"), (None, "u", "same"), (9, "u", "y" * 200_000), (9, "u", "y" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    refs = {r["id"]: r["refers_to"] for r in warc_zip.revisits(pages, "page_id", "html").collect()}
    assert refs == {3: 1, 5: 2, None: 1}  # a null id comes after all others
    later = warc_zip.revisits(pages, "page_id", "html").select(F.col("id").alias("page_id"), F.col("refers_to").cast("string"))
    data = pages.join(later, "page_id", "left").select(F.col("page_id").cast("string").alias("id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"), "refers_to")
    archives = spark.createDataFrame(warc_zip.write_archives(data, f"file://{tmp_path}/z", records=3, zip64=zip64).collect())
    got = warc_zip.read_ranges(warc_zip.archive_ranges(archives, most_bytes=300)).collect()
    assert len(got) == len(rows)
    by_id = {r["record_id"]: r for r in got}
    assert (by_id["3"]["record_type"], by_id["3"]["refers_to"], by_id["3"]["payload_bytes"]) == ("revisit", "1", 4)
    assert bytes(by_id["7"]["payload"]).decode() == "<html>\r\n\r\nX 你</html>" and by_id["9"]["payload_bytes"] == 200_000
    assert by_id[None]["payload_digest"] == by_id["1"]["payload_digest"] == warc_zip.sha1_base32(b"same")


def test_op3_repeated_and_null_ids(spark, tmp_path):
    """Each row of pages is one record, whatever it shares with others."""
    rows = [(1, "X"), (2, "Y"), (9, "X"), (9, "Y"), (None, "X"), (None, "Z"), (3, None), (4, "")]
    folder = str(tmp_path)
    spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    got = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in warc_zip.op3_warc(spark, folder).collect())
    want = [(1, "response", None), (2, "response", None), (9, "revisit", 1), (9, "revisit", 2), (None, "revisit", 1), (None, "response", None), (3, "response", None), (4, "revisit", 3)]
    assert got == Counter(want)


def test_op3_directory_matches_the_zip_format(tmp_path):
    import zipfile

    for zip64 in (False, True):
        path = tmp_path / f"{zip64}.zip"
        with path.open("wb") as f:
            z = warc_zip.ZipWriter(f, zip64)
            z.add("a/b", [b"12", b"345"])
            z.add("c", [b""])
            z.close()
        with zipfile.ZipFile(path) as z:
            assert z.testzip() is None and z.read("a/b") == b"12345"
        with path.open("rb") as f:
            members = warc_zip.zip_members(f, path.stat().st_size)
            assert [m.name for m in members] == ["a/b", "c"]
            assert warc_zip.read_at(f, *warc_zip.stored_range(f, members[0])) == b"12345"


def lz_set(text):
    seen, w = set(), ""
    for c in text:
        w += c
        if w not in seen:
            seen.add(w)
            w = ""
    return seen | ({w} if w else set())


def test_op4_parse_and_neighbours(odd_docs, empty_docs):
    for _, x in pairs_of(odd_docs):
        starts, ends = [], []
        lz_fingerprint.phrases(x or "", set(), starts, ends)
        assert {(x or "")[a:b] for a, b in zip(starts, ends)} == lz_set(x or "")
    rows = sorted(((d if d is not None else -(1 << 63), x or "", d) for d, x in pairs_of(odd_docs)), key=lambda r: (-r[0], r[1]))
    maker, want = lz_fingerprint.Fingerprinter(), Counter()
    for i, (_, x, d) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        m = len(x) // 3
        edited = x[: len(x) - m] + nxt[:m]
        a, b, c = maker.of(x), maker.of(edited), maker.of(nxt)
        want[(d, len(x), hashlib.sha256(edited.encode()).hexdigest(), lz_fingerprint.fingerprint_text(a), lz_fingerprint.fingerprint_text(b), lz_fingerprint.likeness(a, b), lz_fingerprint.likeness(a, c))] += 1
    got = as_rows(lz_fingerprint.with_edits(odd_docs, parts=5), "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    assert got == want
    assert lz_fingerprint.with_edits(empty_docs).count() == 0


def test_op5_budgets(odd_docs, empty_docs):
    rows = mixing.mix(odd_docs, word_count(F.col("text"))).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["copies"] <= 2 for r in rows)
    total = sum(r["size"] for r in rows)
    goals = {r["source"]: (r["source_size"], r["target"]) for r in rows}
    assert abs(sum(t for _, t in goals.values()) - 1.5 * total) < 1e-6 and all(t <= 2 * s + 1e-9 for s, t in goals.values())
    for source, (_, goal) in goals.items():
        mine = [r for r in rows if r["source"] == source]
        ties = Counter()
        for r in mine:
            ties[r["h"]] += r["size"]
        assert abs(sum(r["size"] * r["copies"] for r in mine) - goal) <= max(ties.values()) / 2 + 1
    assert mixing.mix(empty_docs, word_count(F.col("text"))).count() == 0


def test_op6_against_brute_force(odd_docs, empty_docs):
    rows = sorted({(substring.NULL_ID if d is None else d, x, d) for d, x in pairs_of(odd_docs) if x is not None}, key=lambda r: r[0])
    seen, want = [], {}
    for _, x, d in rows:
        kept = []
        for line in x.split("\n"):
            words = frozenset(re.findall(r"[^\x20\x09-\x0D]+", line))
            if not words or not any(9 * len(words & s) >= 4 * (len(words) + len(s)) for s in seen):
                kept.append(line)
            if words:
                seen.append(words)
        want[(d, x)] = "\n".join(kept)
    out = line_dedup.dedup_lines(odd_docs)
    assert out.count() == odd_docs.count()
    got = {(r["doc_id"], r["old"]): r["text"] for r in line_dedup.dedup_lines(odd_docs.withColumn("old", F.col("text"))).select("doc_id", "old", "text").collect() if r["old"] is not None}
    assert got == want
    assert line_dedup.dedup_lines(empty_docs).count() == 0


def test_op6_texts_that_share_half_a_hash(spark):
    """Documents without ids whose texts agree in 31 bits of their hash are told apart."""
    import xxhash

    found, at = {}, 0
    while True:
        text = f"one line of words number{at} here"
        low = xxhash.xxh64_intdigest(text, seed=42) & ((1 << 31) - 1)
        if low in found:
            break
        found[low] = text
        at += 1
    a, b = found[low], text
    docs = spark.createDataFrame([(1, a, 0), (None, a, 1), (None, b + "\nnothing like it", 2), (None, b, 3)] + [(None, f"alone {i} {i + 1} {i * 7}\n{i}", 4 + i) for i in range(300)], "doc_id long, text string, no long")
    got = {r["no"]: (r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(docs).collect()}
    assert got[0] == (a, 0) and got[1] == ("", 1)
    assert sorted([got[2], got[3]]) in ([("", 1), (b + "\nnothing like it", 0)], [("nothing like it", 1), (b, 0)])
    assert all(got[4 + i] == (f"alone {i} {i + 1} {i * 7}\n{i}", 0) for i in range(300))


def test_op6_texts_are_cut_into_words_once(spark):
    """Counts and sets come from the words of lines, not from the texts again; repeated words and blanks count once."""
    texts = spark.createDataFrame([(1, "a b c d e\nrare a b\n\n  "), (2, "a  a\tb c d e f\nx"), (3, "a b " * 70 + " ".join(f"w{i}" for i in range(200)))], "k long, text string").withColumn("t", F.xxhash64("text"))
    lines = line_dedup.line_words(texts).persist()
    levels, slots = line_dedup.rarity_levels(lines)
    sets = line_dedup.line_sets(lines, levels, slots)
    plan = sets._jdf.queryExecution().executedPlan().toString().lower()
    assert "inmemorytablescan" in plan and slots == line_dedup.LEAST_SLOTS
    keys = {(r["k"], r["n"]): r["keys"] for r in lines.collect()}
    rows = {(r["k"], r["n"]): r for r in sets.collect()}
    assert {i: r["size"] for i, r in rows.items()} == {(1, 0): 5, (1, 1): 3, (2, 0): 6, (2, 1): 1, (3, 0): 202} and rows.keys() == keys.keys()
    for i, r in rows.items():
        p = q = 0
        for x in keys[i]:
            p, q = p ^ 1 << (x & 63), q ^ (x >> 6 & 1) << (x & 63)
        signed = lambda v: v - (1 << 64) if v >> 63 else v
        assert (r["p"], r["q"]) == (signed(p), signed(q) if r["size"] > line_dedup.LONG else 0)
        assert len(r["prefix"]) == r["size"] - -(-4 * r["size"] // 5) + 1 and set(r["prefix"]) <= set(keys[i])
    # "rare" stands once, so it comes before "a" and "b".
    assert rows[1, 1]["prefix"][0] not in keys[1, 0]
    pairs = spark.createDataFrame([(2, 0, 1, 0), (1, 1, 1, 0)], "k long, n int, ek long, en int")
    of = texts.select("k", "t")
    pairs = pairs.join(of, "k").join(of.select(F.col("k").alias("ek"), F.col("t").alias("et")), "ek")
    assert [(r["k"], r["n"]) for r in line_dedup.verified(pairs, texts).collect()] == [(2, 0)]
    lines.unpersist()


def labelled(spark, odd_docs):
    rows = [(i, ("you scum idiot %d" if i % 3 == 0 else "a calm day in town %d") % i + " word" * (i % 7), int(i % 3 == 0), int(i % 4 != 0)) for i in range(400)]
    rows = [(i, x if q else "### $$$ %%% &&&\n" + x.upper() + " !!!\n| | |", t, q) for i, x, t, q in rows]
    docs = spark.createDataFrame([(i, x) for i, x, _, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, t) for i, _, t, q in rows] + [(None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_op6_white_space_without_patterns(spark):
    """All white space of a line is blanks, and whole texts aren't run through a regular expression to find out."""
    rows = [f"a{c}b" for c in line_dedup.SPACES] + ["a b", "a\nb", "", None]
    out = spark.createDataFrame([(x,) for x in rows], "x string").select("x", line_dedup._blanks(F.col("x")).alias("y"))
    assert {r["x"]: r["y"] for r in out.collect()} == dict.fromkeys(rows[:5], "a b") | {"a\nb": "a\nb", "": "", None: None}
    assert "rlike" not in out._jdf.queryExecution().executedPlan().toString().lower()


@pytest.mark.parametrize(("module", "label", "limit"), [(toxicity, "toxic", 0.5), (quality, "quality", 0.3)])
def test_op7_op8_held_out(spark, odd_docs, empty_docs, module, label, limit, tmp_path):
    from routeloom.llm.labelled import held_out, training_texts

    docs, labels = labelled(spark, odd_docs)
    trained = module.train(*training_texts(docs, labels, label))
    score = (lambda d: module.score(d, *trained)) if module is toxicity else (lambda d: module.score(d, trained))
    rows = score(docs).join(labels, "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert len(rows) > 50 and sum((r["score"] >= limit) == (r[label] == 1) for r in rows) / len(rows) > 0.97
    odd = score(odd_docs).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert score(empty_docs).count() == 0
    nothing = module.train([], [], 0.25)
    flat = (module.score(docs, *nothing) if module is toxicity else module.score(docs, nothing)).agg(F.min("score"), F.max("score")).first()
    assert np.allclose(list(flat), 0.25)


def test_op8_forward_backward_is_exact():
    import itertools

    rng = np.random.default_rng(3)
    model = quality.Crf(rng.normal(size=4), rng.normal(size=(2, 2)))
    x, per_text = rng.normal(size=(9, 4)), np.array([4, 1, 3, 1])
    good = model.marginals(x, per_text)
    z, at = x @ model.weights, 0
    for n in per_text:
        weight = np.zeros(n)
        total = 0.0
        for y in itertools.product((0, 1), repeat=int(n)):
            s = np.exp(sum((z[at + i] / 2) * (1 if v else -1) for i, v in enumerate(y)) + sum(model.pairs[a, b] for a, b in zip(y, y[1:])))
            total += s
            weight += s * np.array(y)
        assert np.allclose(good[at : at + n], weight / total)
        at += n


def test_op9_against_brute_force(odd_docs, empty_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    rows = pairs_of(odd_docs)
    prints = [simhash.simhash(x) for _, x in rows]
    assert Counter((r["doc_id"], r["fp"]) for r in got) == Counter((d, int(np.uint64(p).view(np.int64))) for (d, _), p in zip(rows, prints))
    ids = [d for d, _ in rows]
    codes = np.array(prints, np.uint64)
    fine = np.array([d is not None for d in ids])
    label = np.array([d if d is not None else -1 for d in ids])
    near = (np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 3) & fine[:, None] & fine[None, :]
    near |= label[:, None] == label[None, :]
    for _ in range(len(ids)):
        label = np.array([label[row].min() for row in near])
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter((d, int(c) if d is not None else None) for d, c in zip(ids, label))
    assert simhash.near_duplicates(empty_docs).count() == 0


def test_op9_rows_of_one_id_are_one_document(spark):
    texts = {5: "a b c d e f", 7: "a b c d e f", 8: "q r s t u v w"}
    rows = [(5, texts[5]), (7, texts[5]), (7, texts[8]), (8, texts[8]), (9, "entirely other words stand here")]
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 5), (7, 5), (8, 5), (9, 9)}


def test_op9_index_and_hot_groups(spark):
    import xxhash

    assert simhash.shingle_hashes([b"a", b"b", b"c", b"d"], 3).tolist() == [xxhash.xxh64_intdigest(b"a b c", 42), xxhash.xxh64_intdigest(b"b c d", 42)]
    rng = np.random.default_rng(2)
    codes = np.unique(np.concatenate([np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, (200, 4)).astype(np.uint64), axis=1) ^ np.uint64(b) for b in rng.integers(0, 1 << 62, 5)]))
    index = simhash.GrayIndex(codes)
    q, c = index.near(index.codes, 3)
    close = np.bitwise_count(index.codes[:, None] ^ index.codes[None, :]) <= 3
    assert close.sum() == len(q) and close[q, c].all()
    df = spark.createDataFrame([(int(x),) for x in codes.view(np.int64)], "fp long")
    label = np.arange(len(codes))
    a, b = np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 3)
    want = simhash._merge(label, a, b)
    signed = codes.view(np.int64)
    for hot in (4096, 8):
        links = simhash.near_links(df, 3, hot).collect()
        place = {int(x): i for i, x in enumerate(signed)}
        got = simhash._merge(np.arange(len(codes)), np.array([place[r["a"]] for r in links]), np.array([place[r["b"]] for r in links]))
        assert (got == want).all()


def test_op10_recall_at_many_dimensions(spark):
    """Vectors without any structure, whose codes tell least: the sample asks for a longer shortlist."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 128))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>").repartition(4)
    found: dict = {}
    for r in additive_ann.search(df, df.where("vec_id % 100 = 0")).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall = []
    for q, got in found.items():
        scores = x @ x[q]
        scores[q] = -9
        recall.append(len(got & set(np.argsort(-scores)[:20].tolist())) / 20)
    assert len(recall) == 60 and np.mean(recall) >= 0.95


def test_op7_scores_by_hand(spark, odd_docs):
    """Each different n-gram of a text counts once, with its weight; whole texts, in any case."""
    rng = np.random.default_rng(2)
    weights = rng.normal(size=1 << toxicity.SLOT_BITS).astype(np.float32) / 50

    def slots(text):
        data, found = b" " + text.encode().lower() + b" ", set()
        for i, n in enumerate(toxicity.ORDERS if text else ()):
            for at in range(len(data) - n + 1):
                code = int.from_bytes(data[at : at + n], "little") * toxicity._MULT[i] + i
                found.add((code & ((1 << 64) - 1)) >> (64 - toxicity.SLOT_BITS))
        return found

    def chance(text):
        z = -0.25 + sum(float(weights[s]) for s in slots(text or ""))
        return 1 / (1 + np.exp(-z))

    texts = dict(odd_docs.where("doc_id < 330").select("doc_id", "text").collect())
    got = {r["doc_id"]: r["score"] for r in toxicity.score(odd_docs, weights, -0.25).collect() if r["doc_id"] is not None and r["doc_id"] < 330}
    assert got.keys() == texts.keys() and all(abs(got[i] - chance(t)) < 1e-5 for i, t in texts.items())


def test_op10_recall_and_oddities(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[300:400] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] + [1.0] * 15), (1060, [None] + [1.0] * 15), (1080, [1.0] * 3), (None, [1.0] * 16), (20, rows[20][1]), (1100, [float("inf")] * 16)]
    df = spark.createDataFrame(rows + odd, "vec_id long, v array<float>")
    got = defaultdict(list)
    for r in additive_ann.search(df, df.where("vec_id % 20 = 0"), block_rows=200, block_queries=7, shortlist=120).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 600, 20))
    wide, hits = x.astype(np.float64), 0
    for q, found in got.items():
        s = wide @ wide[q]
        best = sorted((i for i in range(600) if i != q), key=lambda i: (-s[i], i))[:20]
        hits += len({i for i, _ in found} & set(best))
        assert len(found) == 20 and np.allclose([v for _, v in found], [s[i] for i, _ in found])
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
    assert hits / (20 * len(got)) >= 0.9
    assert additive_ann.search(df.where("false"), df.where("false")).count() == 0
