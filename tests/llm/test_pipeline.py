"""The pipeline stage by stage, and every registered query of this package on the smallest tables."""

import corpus_pipeline
import oracle
import pytest

from engram.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    if name in queries.ORACLES:
        _, _, problems = oracle.compare(df, con, queries.ORACLES[name])
        assert not problems, problems
    else:
        assert len(df.collect()) > 0


def test_stages_keep_columns_and_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "doc_id AS features", "source AS score", "1 AS lines")
    toxic = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert toxic.columns == docs.columns and 0 < toxic.count() < docs.count()
    assert all(r["features"] == r["doc_id"] and r["score"] == r["source"] for r in toxic.collect())
    lined = corpus_pipeline.drop_repeated_lines(spark, docs, SF)
    assert lined.columns == docs.columns and lined.filter("n_chars != length(text)").count() == 0
    alone = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert alone.columns == docs.columns and alone.select("text").distinct().count() == alone.count()
    cut = corpus_pipeline.cut_benchmark_passages(spark, docs, SF)
    assert cut.columns == docs.columns
    assert corpus_pipeline.drop_near_copies(spark, alone, SF).count() == alone.count()


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(r["taken"] <= 3 * r["size"] for r in rows)
