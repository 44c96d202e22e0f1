"""The pipeline against a brute-force version of its exact stages, and the queries against SQL."""

import glob
import os

import duckdb
import pytest

import corpus_pipeline
from tessera.llm import quality, queries
from tests.llm.test_operators import brute_contamination, components, pairs

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    kept = {r[0] for r in quality.quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()}
    rows = [r for r in rows if r[0] in kept]
    single = {int(d) for d, _, c, own in components(rows, 80) if own}
    rows = [r for r in rows if r[0] in single]
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {int(x[0]) for x in brute_contamination(rows, bench) if not x[-1]}
    got = out.collect()
    assert {r["doc_id"] for r in got} == clean and len(got) == len(clean)
    assert out.columns[: len(docs.columns)] == docs.columns
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert len({r["mix_position"] for r in got}) == len(got)


def test_stages_on_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b c", "en", None, 5), (3, "a b c", "en", None, 5), (None, "a b c d e f", "en", "s", 11), (None, "u v w x y z", "en", "s", 11), (None, "u v w x y z", "en", "s", 11)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    for where in (tmp_path, f"{tmp_path}/none"):
        for name in ("labels", "benchmark"):
            spark.read.parquet(f"{SF}/{name}.parquet").where("false").write.parquet(f"{where}/{name}.parquet")
    assert sorted(str(r[0]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == ["3", "None", "None"]
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_groups_of_repeated_ids(spark):
    """A doc_id on rows of several groups: every group keeps one row, whatever becomes of the others."""
    w = lambda a: " ".join(f"{a}{k}" for k in range(60))
    a, b, c = w("a"), w("b"), w("c")
    rows = [(3, a), (5, a + " x"), (5, b), (7, b + " y"), (None, c), (None, c + " z"), (9, c), (None, w("d")), (None, w("d")), (11, ""), (11, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, cluster int, set_id int")
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((x["doc_id"], x["text"]) for x in got.collect()), key=str) == sorted([(3, a), (5, b), (9, c), (None, w("d")), (11, ""), (None, None)], key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    found = c.sql(queries.ORACLE[name])
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(found.columns)
    key = lambda row: tuple("None" if v is None else str(v) for v in row)
    assert sorted(key(r) for r in df.select(found.columns).collect()) == sorted(key(r) for r in found.fetchall())
