"""Registered queries over the smallest tables: shapes, whole tables, and DuckDB's rows where SQL can express them."""

import duckdb
import pytest

from quarry.llm import queries

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_sharding": "doc_id size text_crc32 law shard slot grown_shard", "op2_substring_dedup": "doc_id n_words n_removed kept_sha256", "op3_suffix_array_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op4_exact_top_k": "query_id rank vec_id score", "op5_minhash_near_dedup": "doc_id n_shingles component_id kept", "op6_toxicity": "doc_id held_out score predicted",
    "op7_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans", "op8_mixing": "doc_id size source_size target taken",
}
TYPES = {"shard": "int", "grown_shard": "int", "rank": "int", "predicted": "int", "score": None, "target": "double", "law": "string", "spans": "string", "kept": "boolean", "held_out": "boolean", "kept_sha256": "string", "base_sha256": "string"}


@pytest.mark.parametrize("name", queries.queries())
def test_query(spark, name):
    df = queries.queries()[name](spark, FOLDER)
    types = dict(df.dtypes)
    for c in COLUMNS.get(name, "").split():
        want = TYPES.get(c, "bigint")
        assert want is None or types[c] == want, c
    rows = df.collect()
    if "doc_id" in COLUMNS.get(name, ""):
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect())
    if name in queries.oracle_sql():
        con = duckdb.connect()
        for t in ("documents", "embeddings", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
        found = con.execute(queries.oracle_sql()[name])
        names = [d[0] for d in found.description]
        assert sorted(map(str, found.fetchall())) == sorted(str(tuple(r[c] for c in names)) for r in rows)
