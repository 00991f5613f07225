"""Queries with SQL give the same rows in DuckDB; all give a row for each row of their table where that is promised."""

import duckdb
import pytest

from spindrift.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(SQL[name]).df()
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    assert sorted(map(repr, got[names].astype(object).where(got[names].notna(), None).values.tolist())) == sorted(map(repr, want[names].astype(object).where(want[names].notna(), None).values.tolist()))


@pytest.mark.parametrize(("name", "columns"), [
    ("op3_lattice_dedup", {"vec_id", "n_links", "component_id", "kept"}), ("op4_piece_codec", {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}),
    ("op7_ngram_jaccard_join", {"doc_id", "class_id", "n_links", "component_id", "kept"}), ("op8_interleaved_sharding", {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}),
    ("op10_language_spans", {"doc_id", "held_out", "lang_pred", "score"}),
])
def test_one_row_each(spark, name, columns):
    got = QUERIES[name](spark, SF)
    table = "embeddings" if name.startswith("op3") else "documents"
    assert columns <= set(got.columns) and got.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
