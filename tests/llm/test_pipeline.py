"""The pipeline's stages on a small input, and the registration."""

from inkwell.session import materialize


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert "op1_url_rules" in __spark_entry__.oracle_sql()


def test_stages(spark):
    import os

    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        return
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = materialize(stage(spark, docs, folder), f"test-{name}")
        after = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert after <= before and len(after) > 0.7 * len(before), name
        assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    assert docs.where("not decodes").count() == 0


def test_url_query_equals_sql(spark):
    import os

    from compare import TESTDATA, check, connect
    from inkwell.llm.catalog import ORACLES, QUERIES

    folder = f"{TESTDATA}/sf0.001"
    if os.path.isdir(folder):
        for name, sql in ORACLES.items():
            assert check(spark, connect(folder), folder, QUERIES[name], sql) is None
