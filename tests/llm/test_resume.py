"""A pipeline that failed goes on after the stages it had finished."""

import pytest

import corpus_pipeline


def test_finished_stages_are_not_run_again(spark, tmp_path, monkeypatch):
    sf_dir, folder, ran = str(tmp_path / "sf"), str(tmp_path / "out"), []
    spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string").write.parquet(f"{sf_dir}/documents.parquet")

    def stage(name, fails):
        def f(spark, docs, sf_dir):
            ran.append(name)
            if fails and ran.count(name) == 1:
                # A job that breaks off in the middle of its write.
                return docs.selectExpr("doc_id", "if(doc_id = 19, raise_error('lost'), text) AS text")
            return docs.where(f"doc_id % 20 <> {len(name)}")

        return name, f

    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage("a", False), stage("bb", True), stage("ccc", False)])
    with pytest.raises(Exception, match="lost"):
        corpus_pipeline.run(spark, sf_dir, folder).count()
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf_dir, folder).collect()) == [0, *range(4, 20)]
    assert ran == ["a", "bb", "bb", "ccc"]
    assert corpus_pipeline.run(spark, sf_dir).count() == 17 and ran[4:] == ["a", "bb", "ccc"]


def test_changed_input_is_not_answered_by_what_an_earlier_run_left(spark, tmp_path, monkeypatch):
    sf_dir, folder = str(tmp_path / "sf"), str(tmp_path / "out")
    keep = ("keep", lambda spark, docs, sf_dir: docs.where("doc_id >= 0"))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [keep, ("last", lambda spark, docs, sf_dir: docs.select("doc_id"))])
    for n in (5, 9):
        spark.range(n).selectExpr("id AS doc_id", "'t' AS text").write.mode("overwrite").parquet(f"{sf_dir}/documents.parquet")
        assert corpus_pipeline.run(spark, sf_dir, folder).count() == n
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    assert corpus_pipeline.run(spark, sf_dir, folder).count() == 9
    assert len(list((tmp_path / "out").iterdir())) == 3
