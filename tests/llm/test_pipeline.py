import corpus_pipeline
from factloom.llm import common
from tests.llm.data import documents, frame
from tests.llm.test_dedup import crowd, near_brute


def test_the_near_duplicate_stage_keeps_one_of_a_crowd(spark):
    rows = crowd(330, 15, 50_000) + documents(n=20)
    kept = corpus_pipeline.near_duplicates(spark, frame(spark, rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(near_brute(rows, 5, 0.8).values()))


def test_the_last_stages_keep_columns_of_any_name(spark, tmp_path):
    df = spark.createDataFrame([(1, "a text", 5, 6, "x"), (2, None, 7, 8, "y"), (2, None, 7, 8, "y")], "doc_id long, text string, _crc long, _decoded long, `a.b` string")
    spark.createDataFrame([(1, "nothing like it at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = corpus_pipeline.benchmark(spark, df, str(tmp_path))
    assert clean.columns == df.columns and clean.count() == 3
    out = corpus_pipeline.tokens(spark, clean, "")
    assert out.columns == ["doc_id", "_crc", "_decoded", "a.b", "n_tokens", "ids", "round_trip"]
    assert sorted((r.doc_id, r._crc, r._decoded, r["a.b"], r.round_trip) for r in out.collect()) == [(1, 5, 6, "x", True), (2, 7, 8, "y", True), (2, 7, 8, "y", True)]


def test_an_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "nothing like it at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_pipeline_runs_over_odd_documents(spark, tmp_path):
    rows = [(d, t, "fr" if d % 2 else "en", "src", len(t or "")) for d, t in documents(n=40)]
    rows.append((9000, rows[0][1] + " extra words at the very end of it", "en", "src", 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, rows[3][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r.doc_id for r in out]
    assert len(set(ids)) == len(ids) > 5 and rows[3][0] not in ids and {2000, 2001, 2002}.isdisjoint(ids)
    assert all(r.round_trip for r in out)
    assert len(corpus_pipeline.STAGES) == 5


def test_writing_a_table_hands_freed_native_memory_back(spark, monkeypatch):
    assert common.trim(spark)
    calls = []
    monkeypatch.setattr(common, "trim", calls.append)
    assert common.materialised(spark.range(3)).count() == 3 and len(calls) == 1
