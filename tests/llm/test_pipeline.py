import corpus_pipeline
from loadlens.llm import queries

from . import odd


def tables(spark, folder, docs, n_labels=1):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (5, 0, 0)][:n_labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, odd.words(3, 40))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_pipeline_on_odd_rows(spark, folder):
    got = corpus_pipeline.run(spark, tables(spark, folder, odd.docs(spark))).collect()
    ids = [r["doc_id"] for r in got]
    # The copies of document 1 go, the benchmark passage of document 12 goes, and the rest stays.
    assert ids.count(1) == 1 and 2 not in ids and {7, 8, 13} <= set(ids)
    assert len([i for i in ids if i == 12]) == 1 and len([i for i in ids if i in (9, 10)]) == 1


def test_stages_keep_columns_and_empty_tables(spark, folder):
    folder = tables(spark, folder, odd.empty(spark), 0)
    docs = odd.empty(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == odd.empty(spark).columns and docs.count() == 0
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_every_operator_has_one_query():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(names)
