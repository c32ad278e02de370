"""Each registered query of the training-data operators, once over a small table: rows, names and types that it promises."""

import hashlib

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
KEPT = {"doc_id": "bigint", "kept_sha256": "string"}
PROMISED = {
    "op1_substring": KEPT | {"n_words": "bigint", "n_removed": "bigint"},
    "op2_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op3_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op4_fingerprint": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op5_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op6_line_dedup": KEPT | {"n_lines": "bigint", "n_removed": "bigint"},
    "op7_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op9_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op10_ann": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op11_vector_codes": {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"},
    "op12_maxent_lm": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op13_divergence": {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"},
}


@pytest.mark.parametrize("name", PROMISED)
def test_registered(spark, name):
    out = __spark_entry__.queries()[name](spark, SF)
    kinds = dict(out.dtypes)
    assert {c: kinds.get(c) for c in PROMISED[name]} == PROMISED[name]
    rows = out.collect()
    if name == "op1_substring":
        texts = {r["doc_id"]: (r["text"] or "").encode().split() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
        assert len(rows) == len(texts) and all(r["n_words"] == len(texts[r["doc_id"]]) for r in rows)
        assert all(r["kept_sha256"] == hashlib.sha256(b" ".join(texts[r["doc_id"]])).hexdigest() for r in rows if not r["n_removed"])
    elif name == "op10_ann":
        assert all(r["query_id"] % 20 == 0 and r["query_id"] != r["vec_id"] and 1 <= r["rank"] <= 20 for r in rows)
    elif name not in ("op2_packing", "op13_divergence"):
        source = {"op3_warc": "pages", "op11_vector_codes": "embeddings"}.get(name, "documents")
        assert len(rows) == spark.read.parquet(f"{SF}/{source}.parquet").count()
    assert rows


def test_entries():
    """Every query is callable, every oracle is SQL for one of them."""
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert all(map(callable, queries.values())) and all(isinstance(x, str) for x in oracles.values()) and oracles.keys() <= queries.keys()
    assert {f"op{i}" for i in range(1, 14)} == {k.split("_")[0] for k in queries if k.startswith("op") and k[2].isdigit()}
