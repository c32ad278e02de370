"""The maximum-entropy language model: exact counts and base scores by brute force, the model by its own definition and on held-out texts."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from routeloom import llm
from routeloom.llm import maxent_lm as lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score) of rows (doc_id, text)."""
    docs = [(i, zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2, [*WORD.findall((t or "").translate(LOWER)), None]) for i, t in rows]
    counts = Counter(w for _, held, words in docs if not held for w in words)
    n, v = sum(counts.values()), len(counts)
    return [(i, held, len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for i, held, ws in docs]


def same(out, rows):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in out.collect()), key=key)
    want = sorted(brute(rows), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9, abs=1e-9)


def corpus(n=150):
    rng = random.Random(4)
    words = [["a1", "b1", "C1", "Éa", "d-1"], ["x2", "y2", "Z2", "日本", "u u"]]
    text = lambda k: rng.choice([" ", "\n", "\t", "  "]).join(rng.choice(words[k]) if rng.random() < 0.9 else f"rare{rng.random()}" for _ in range(rng.randint(0, 60)))
    rows = [(i, text(i % 2)) for i in range(n)]
    return rows + [(None, None), (None, "a1 b1"), (500, None), (501, ""), (502, " \n\t "), (503, "once " * 9000), (504, "x" * 5000)] + [rows[3]] * 3 + [rows[12]]


def made(spark, rows):
    return spark.createDataFrame([(*r, "x", "x") for r in rows], "doc_id long, text string, score string, row string").repartition(4)


@pytest.fixture(scope="module")
def scored(spark):
    return lm.score(made(spark, corpus()), frequent=20)


def test_counts_and_base_scores(scored):
    assert scored.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")]
    same(scored, corpus())


def test_equal_texts_score_alike_and_context_helps(scored):
    rows = scored.collect()
    assert len({round(r["score"], 6) for r in rows if r["doc_id"] == 3}) == 1 and all(math.isfinite(r["score"]) and r["score"] <= 0 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = [(held, "some words"), (held, "")]
    same(lm.score(made(spark, rows)), rows)
    assert lm.score(made(spark, rows).where("false")).count() == 0


def lexicon_of(words):
    unit = np.append(np.arange(len(words)), lm.RARE)
    return lm.Lexicon(words, np.arange(len(words), 0, -1), unit, 3, 100, len(words) + 5)


def random_model(lex, seed):
    rng = np.random.default_rng(seed)
    model = lm.first_model(lex, rng.random((lm.WORDS, lm.ANCHORS)))
    model.weights[:] = rng.normal(0, 0.3, model.weights.shape)
    model.bias[:] = rng.normal(-3, 1, model.bias.shape)
    return model


def test_chances_of_all_units_sum_to_one():
    lex = lexicon_of([b"w%d" % i for i in range(50)])
    model = random_model(lex, 1)
    units = np.arange(lm.WORDS + 2)
    for before in ([1, 2], [50, 51]):
        p = 10 ** model.log10(units, np.repeat(np.array(before)[:, None], len(units), axis=1))
        assert p.sum() == pytest.approx(1, abs=1e-5) and (p > 0).all()


def test_log_chance_by_hand():
    lex = lexicon_of([b"w%d" % i for i in range(50)])
    model = random_model(lex, 2)
    _, units, before = lm.events(lex, [np.array([4, 50, 7]), np.array([], np.int64), np.array([9])])
    assert units.tolist() == [4, lm.RARE, 7, lm.END, lm.END, 9, lm.END] and before[:, 3].tolist() == [7, 50] and before[:, 4].tolist() == [51] * 2
    got = model.log10(units, before)
    for i, u in enumerate(units):
        path = [(0, lm.CLASSES + u - lm.WORDS)]
        if u < lm.WORDS:
            leaf = int(model.place[u])
            path = [(0, leaf // 256), (1 + leaf // 256, leaf // 16 % 16), (1 + lm.CLASSES + leaf // 16, leaf % 16)]
        total = 0.0
        for level, (node, child) in enumerate(path):
            z = model.bias[node].astype(float)
            for t, (at, places, n) in enumerate(lm.TABLES):
                if at == level:
                    row = lm._hash([before[p - 1][i : i + 1] for p in places], np.array([node]), t, n)[0]
                    z = z + model.weights[lm.FIRST_ROW[t] + int(row)]
            total += (z[child] - np.log(np.exp(z).sum())) / math.log(10)
        assert got[i] == pytest.approx(total, abs=1e-4)


def test_gradient_by_differences():
    lex = lexicon_of([b"w%d" % i for i in range(50)])
    learner = lm.Learner(random_model(lex, 3))
    learner.model.weights = learner.model.weights.astype(np.float64)
    learner.model.bias = learner.model.bias.astype(np.float64)
    rng = np.random.default_rng(5)
    _, units, before = lm.events(lex, [rng.integers(0, 51, 40), rng.integers(0, 51, 10)])
    loss = lambda: -learner.model.log10(units, before).sum() * math.log(10)
    for rows, g, _ in learner.gradient(units, before):
        for i in rng.integers(0, len(rows), 3):
            for c in (0, 14, 15):
                at = learner.model.weights[rows[i]]
                at[c] += 1e-3
                up = loss()
                at[c] -= 2e-3
                down = loss()
                at[c] += 1e-3
                assert g[i, c] == pytest.approx((up - down) / 2e-3, abs=1e-3)


def test_registered_query_beats_the_base(spark):
    sf = "/root/testdata/sf0.01"
    out = llm.queries()["op12_maxent_lm"](spark, sf)
    same(out, [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])
    held = [r for r in out.collect() if r["held_out"]]
    gain = sum(r["score"] - r["base_score"] for r in held) / sum(r["n_tokens"] for r in held)
    assert gain > 0.1 and sum(r["score"] > r["base_score"] for r in held) > 0.9 * len(held)


def test_packed_sums():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 5)).astype(np.float32)
    assert (lm._unpack(lm._pack(x, False), 30, 5, False) == x).all()
    x[:, -1] = rng.integers(0, 10**6, 30)
    x[:, :-1] *= x[:, -1:]
    back = lm._unpack(lm._pack(x, True), 30, 5, True)
    assert (back[:, -1] == x[:, -1]).all() and np.allclose(back, x, rtol=1e-3, atol=1e-3 * x[:, -1].max())


def test_least_total(spark):
    rng = random.Random(6)
    for n in (0, 5, 300):
        totals = sorted((int(rng.paretovariate(0.4)) for _ in range(n)), reverse=True)
        df = spark.createDataFrame([(str(i), t) for i, t in enumerate(totals)], "word string, total long")
        for most in (1, 4, 17, 120, 299, 300):
            least = lm.least_total(df, most)
            assert sum(t >= least for t in totals) <= most
            assert least == 1 or sum(t >= least - 1 for t in totals) > most or not any(t == least - 1 for t in totals)
