"""The pipeline stage by stage: each works on what the one before kept, and clean documents stay."""

import corpus_pipeline
from listing_engine.llm import decontamination, near_duplicates, pii, toxicity
from tests.llm.conftest import SF


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        held[name] = before, docs
        assert name == "byte_bpe" or docs.columns == columns
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}

    before, after = held["toxicity"]
    scored = toxicity.toxicity(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(after) == ids(scored.filter("toxicity_score < 0.5"))
    before, after = held["near_duplicates"]
    members = near_duplicates.similar_texts(before)
    assert ids(after) == {r[0] for r in members.select("component_id").distinct().collect()}
    before, after = held["decontamination"]
    found = decontamination.overlaps(before, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert ids(before) - ids(after) == ids(found) and ids(found)
    before, after = held["pii"]
    new = {r["doc_id"]: r for r in after.collect()}
    for r in before.collect():
        assert new[r["doc_id"]]["text"] == pii.pseudonymized(r["text"])[0] and new[r["doc_id"]]["n_chars"] == len(new[r["doc_id"]]["text"])
    before, after = held["byte_bpe"]
    assert ids(before) == ids(after) and after.filter("not round_trip").isEmpty()


def test_stages_on_odd_rows(spark, odd_docs, no_docs, tmp_path):
    for n, start in enumerate((odd_docs, no_docs)):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF).write.parquet(str(tmp_path / f"{n}-{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{n}-{name}"))
        assert (docs.count() > 0) == (n == 0)
