"""The stages on a small corpus with odd rows, and on an empty one."""

import corpus_pipeline


def tables(table, llm_spark, folder, rows):
    table(rows).write.parquet(f"{folder}/documents.parquet")
    llm_spark.createDataFrame([(4, 0), (8, 0), (20, 1)], "doc_id bigint, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_stages(table, llm_spark, odd_rows, tmp_path):
    tables(table, llm_spark, tmp_path, odd_rows)
    docs = llm_spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kinds = docs.columns, docs.dtypes
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(llm_spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = llm_spark.read.parquet(f"{tmp_path}/{name}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and docs.dtypes == kinds
            if k > 1:
                assert all(r["n_chars"] == len(r["text"]) for r in docs.filter("text IS NOT NULL").select("n_chars", "text").collect())
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} <= {i for i, _ in odd_rows}


def test_empty_corpus(table, llm_spark, tmp_path):
    tables(table, llm_spark, tmp_path, [(1, "x")])
    table([(1, "x")]).filter("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    llm_spark.createDataFrame([], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(llm_spark, f"{tmp_path}/none").count() == 0
