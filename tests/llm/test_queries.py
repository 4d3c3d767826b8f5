"""Every registered query: its columns, and what must hold of its rows."""

import zlib

import pytest

from pixelloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op2_decontaminate": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op3_token_ids": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op4_license_scan": {"doc_id": "bigint"},
    "op5_packing": {"doc_id": "bigint", "bin_id": "bigint", "capacity": "int", "offset": "int"},
    "op6_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op7_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op8_near_duplicates": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op9_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10_line_dedup": {"doc_id": "bigint"},
}


def test_registry():
    assert set(QUERIES) == set(COLUMNS) and set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    got = QUERIES[name](spark, SF)
    kinds = dict(got.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    rows = got.collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    if name not in ("op1_url_filter", "op4_license_scan", "op5_packing"):
        assert sorted(r.doc_id for r in rows) == sorted(texts)
    if name == "op1_url_filter":
        assert sorted(r.page_id for r in rows) == sorted(r.page_id for r in spark.read.parquet(f"{SF}/pages.parquet").collect())
        assert all(r.verdict in ("allow", "block") and r.rule in (None, "org/", "example.org/es/", "example.org/en/1", "com/fr/", "com/de/") for r in rows)
        assert all(r.verdict == ("allow" if r.rule in ("org/", "com/fr/") else "block") for r in rows if r.rule)
    if name == "op3_token_ids":
        rows.sort(key=lambda r: r.doc_id)
        assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]
    if name == "op5_packing":
        assert {r.doc_id for r in rows} == set(texts) and all(r.offset + r.length <= r.capacity for r in rows)
    if name == "op6_sharding":
        assert all((r.size, r.text_crc32) == (len(texts[r.doc_id].encode()) + 1, zlib.crc32(texts[r.doc_id].encode())) for r in rows)
        for shard in range(16):
            assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
        sizes = [sum(r.shard == k for r in rows) for k in range(16)]
        assert {r.law for r in rows} == {"rows"} and max(sizes) - min(sizes) <= 1
    if name == "op9_quality":
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
