import pytest
from test_entry import SF, same

import corpus_pipeline
from tremor.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    same(spark, name)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_runs_over_the_whole_table(spark, name):
    rows = queries.QUERIES[name](spark, SF).count()
    tables = {"op1_html_main_text": "pages"}
    if name not in ("op4_licence_scan", "op7_repeated_passages"):
        assert rows >= spark.read.parquet(f"{SF}/{tables.get(name, 'documents')}.parquet").count()


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, SF)
        assert out.schema == docs.schema
        out.write.parquet(str(tmp_path / str(i)))
        before, docs = docs.count(), spark.read.parquet(str(tmp_path / str(i)))
        assert docs.count() <= before and (i < 2 or docs.count() == before)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.filter("piece = 0").count() == docs.count() == corpus_pipeline.run(spark, SF).filter("piece = 0").count()
