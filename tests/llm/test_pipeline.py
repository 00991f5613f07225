import corpus_pipeline as P

from spindrift.llm.queries import QUERIES, SQL

from .fixtures import docs, rows


def test_stages_keep_columns_and_cut(spark, tmp_path):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs(spark).select(*names).write.parquet(str(tmp_path / "documents.parquet"))
    now, left = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in P.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == names
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        left.append(sorted(r.doc_id for r in now.collect() if r.doc_id is not None))
    assert len(left[0]) < len(rows()) and 4 not in left[0] and 2 not in left[1] and 3 in left[1] and 3 not in left[2] and left[3] == left[2]
    ten = now.where("doc_id = 10").first()
    assert len(ten.text.split()) == 45 and ten.n_chars == len(ten.text)
    packed = P.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect() if r.doc_id is not None} == set(left[3])
    assert len(P.STAGES) == 5 and P.ORACLE_SQL is None


def test_each_operator_has_one_query():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14)) and set(SQL) <= set(QUERIES)
