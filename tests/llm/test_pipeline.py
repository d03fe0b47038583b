import corpus_pipeline
from quern.llm import jaccard_join, toxicity
from quern.llm.common import table
from tests.conftest import SF


def test_stages(spark):
    docs = table(spark, SF, "documents")
    first = corpus_pipeline.reject_toxic(spark, docs, SF)
    net = toxicity.learn(docs, table(spark, SF, "labels"))
    toxic = {r.doc_id for r in toxicity.score(docs, net).collect() if r.predicted}
    assert {r.doc_id for r in first.collect()} == {r.doc_id for r in docs.collect()} - toxic
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.settle(stage(spark, docs, SF))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert docs.where("text IS NOT NULL AND n_chars <> char_length(text)").count() == 0
    assert {r.doc_id for r in jaccard_join.join(docs).where("doc_id <> component_id").collect()} == set()


def test_run(spark):
    pieces = corpus_pipeline.run(spark, SF)
    assert pieces.columns[:2] == ["doc_id", "start"] and pieces.count() > 0


def test_odd_rows_go_through(spark, odd, tmp_path):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([(4, 1, 0), (6, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() > 0, name
        docs = docs if name == "packing" else out


def test_empty_tables_go_through(spark, make, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = make([]).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_names_of_the_operators_go_through(spark, odd, tmp_path):
    """Columns that are called as the operators call theirs stay what they are."""
    docs = odd.withColumnsRenamed({"key": "_gone", "n": "_found", "bits": "row", "bucket": "_twice", "label": "host", "block": "drop"})
    spark.createDataFrame([(4, 1, 0), (6, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and {(r._gone, r._found, r._twice, r.host, r.drop) for r in out.collect()} == {("k", 1, 3, "x", 9)}, name
        docs = out
