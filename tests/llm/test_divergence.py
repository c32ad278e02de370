"""Source divergence against its SQL and a brute-force version."""

import random
import re
from collections import Counter

import duckdb
import pytest

from routeloom import llm
from routeloom.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=30, top=50):
    lower = {i: i + 32 for i in range(65, 91)}
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(lower))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        frequency = Counter(t for _, _, words in mine for t in set(words))
        kept = sorted(t for t, n in frequency.items() if n >= least)
        v = len(kept)
        counts = {s: Counter(t for _, x, words in mine if x == s for t in words if frequency[t] >= least) for _, s, _ in mine}
        whole = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + (10**9 * (c[t] + 5)) // (sum(c.values()) + 5 * v) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        for s in counts:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in counts if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found[:most])]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def corpus(n=400):
    rng = random.Random(11)
    words = ["the", "The", "éa", "Éa", "b", "naïve", "x y", "zz", "l'eau", "a_b", "q1q", "日本", "\x7fdel", "𝒳"]
    text = lambda: rng.choice([" ", "\n", "--", "\t", " ! "]).join(rng.choice(words[: rng.randint(1, len(words))]) for _ in range(rng.randint(0, 12)))
    rows = [(text(), rng.choice(["en", "fr", None, ""]), rng.choice(["s0"] * 6 + ["s1", "s2", None, "s10", "ß"])) for _ in range(n)]
    return rows + [(None, "en", "s1"), ("", "de", "only"), ("few words here", "it", "a"), ("other words", "it", "b"), ("word " * 5000, "en", "s0")] + [rows[0]] * 3


def made(spark, rows):
    return spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "text string, lang string, source string, cnt long, term string").repartition(4)


@pytest.mark.parametrize("shard_bytes", [1 << 20, 40])
def test_against_brute_force(spark, shard_bytes):
    rows = corpus()
    out = divergence.audit(made(spark, rows), shard_bytes=shard_bytes)
    assert out.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert got(out) == brute(rows)


def test_few_terms_and_small_tasks(spark, monkeypatch):
    rows = corpus(60)
    assert got(divergence.audit(made(spark, rows), least_docs=1, top=3)) == brute(rows, 1, 3)
    assert got(divergence.audit(made(spark, rows).where("false"))) == []


def test_shares_of_large_counts(spark):
    from pyspark.sql import functions as F

    n = 9 * 10**15
    row = spark.createDataFrame([(n, 7 * n, 10**9)], "c long, n long, v long").select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).first()
    assert row[0] == 1 + 10**9 * (n + 5) // (7 * n + 5 * 10**9)


def test_registered_query_matches_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(f"SELECT lang, source, part, item, value, rank FROM ({llm.oracle_sql()['op13_divergence']})").fetchall()
    assert got(llm.queries()["op13_divergence"](spark, sf)) == sorted(want)
