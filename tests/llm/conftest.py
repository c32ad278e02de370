import random

import pytest

#: Columns whose names the operators use inside.
EXTRA = ("part", "kind", "h", "size", "copies", "k", "m", "score", "n_lines", "component_id", "fp")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, repeated rows, ties, near copies, and clashing columns."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    text = lambda n: "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 25))) for _ in range(n))
    base = text(8)
    rows = [(i, text(rng.randint(1, 6)), rng.choice(["a", "b", None])) for i in range(40)]
    rows += [(100 + i, base, "a") for i in range(12)]
    rows += [(200 + i, base.replace(base.split()[5 + i], "zz"), "a") for i in range(10)]
    rows += [(300, None, "b"), (301, "", "b"), (302, " \n\t ", None), (303, "one two", "a"), (304, text(400), "c"), (305, "x" * 5000, "c"), (None, base, None), (None, None, None)]
    rows += [(400, "repeat me please\nrepeat me please\n\nother line here", "b")] * 3 + [(401, "Same Words again", "b"), (402, "same words again", "b")]
    rows += [(500, "shared " + " ".join(words[:20]) + " first end", "a"), (501, "other " + " ".join(words[:20]) + " second end", "a")]
    schema = "doc_id long, text string, source string, lang string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
    data = [(*r, None, None if r[1] is None else len(r[1]), *["x"] * len(EXTRA)) for r in rows]
    return spark.createDataFrame(data, schema).repartition(3)


@pytest.fixture(scope="session")
def empty_docs(odd_docs):
    return odd_docs.where("false")
