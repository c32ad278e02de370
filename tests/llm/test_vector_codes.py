"""Vector codes against a brute-force version in Python's integers."""

import hashlib
import math
import random

import pytest

from routeloom.llm import vector_codes as vc


def brute(rows, parts=16, entries=64, rounds=2):
    """rows: (vec_id, vector, label) that take part."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(256 * x) if abs(x) < 1e15 else 256 * int(x) for x in v] for _, v, _ in rows]
    width = len(whole[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in whole]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min((far(v[p], e), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        groups = [[[] for _ in b] for b in books]
        for v in cut:
            for p in range(parts):
                groups[p][near(v, p)[1]].append(v[p])
        books = [[[sum(c) // len(g) for c in zip(*g, strict=True)] if g else e for e, g in zip(b, gs, strict=True)] for b, gs in zip(books, groups, strict=True)]
    found = [[near(v, p) for p in range(parts)] for v in cut]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in f) for f in found]
    by = {}
    for (_, _, label), e in zip(rows, errors, strict=True):
        by[label] = by.get(label, 0) + e
    most = (1 << 63) - 1
    return sorted((-1 if i is None else i, "".join(f"{c:02x}" for _, c in f), min(e, most), min(by[label], most), sha) for (i, _, label), f, e in zip(rows, found, errors, strict=True))


def got(df):
    return sorted((-1 if r["vec_id"] is None else r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


SCHEMA = "vec_id long, v array<double>, label int, code string, error string"


def made(spark, rows):
    return spark.createDataFrame([(*r, "x", "x") for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("n", [1, 40, 700])
def test_against_brute_force(spark, n):
    rng = random.Random(n)
    rows = [(i, [rng.gauss(0, 1) for _ in range(32)], rng.choice([1, 2, None])) for i in rng.sample(range(10**6), n)]
    rows += [rows[0], (None, rows[0][1], 3), (rows[0][0], [-0.0] * 32, 1)]
    odd = [(7, None, 1), (8, [float("nan")] + [0.0] * 31, 1), (9, [None] * 32, 1), (10, [float("-inf")] * 32, 1), (11, [], 1), (12, [1.0] * 16, 1), (13, [1.0] * 33, 1)]
    assert got(vc.compress(made(spark, rows + odd))) == brute(rows)


def test_ties_and_hot_rows(spark):
    rows = [(i, [float(i % 3)] * 16, 5) for i in range(300)]
    assert got(vc.compress(made(spark, rows))) == brute(rows)


def test_large_components(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([1, -1]) * 10.0 ** rng.randint(-40, 12) for _ in range(16)], 1) for i in range(90)]
    assert got(vc.compress(made(spark, rows))) == brute(rows)
    rows = [(i, [rng.choice([1e300, -1e300, 1e-300, -1e308]) for _ in range(16)], None) for i in range(70)]
    assert got(vc.compress(made(spark, rows))) == brute(rows)


def test_nothing_to_compress(spark):
    out = vc.compress(made(spark, [(1, None, 1)]))
    assert out.count() == 0 and out.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]


def test_registered_query(spark):
    from routeloom import llm

    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got(llm.queries()["op11_vector_codes"](spark, sf)) == brute([r for r in rows if r[1] is not None])
