"""The pipeline's stages take effect and its result is what its stages give."""

from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from relicframe.llm import mixing, packing, quality, simhash, toxicity

SF = "/root/testdata/sf0.01"


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert docs.columns == before.columns
        if name == "quality":
            judged = {r.doc_id for r in quality.quality_rules(before, labels).where("kept").collect()}
            assert {r.doc_id for r in docs.collect()} == judged
        if name == "toxicity":
            clean = {r.doc_id for r in toxicity.toxicity_scores(before, labels).where("NOT is_toxic").collect()}
            assert {r.doc_id for r in docs.collect()} == clean and docs.count() < before.count()
        if name == "near_duplicates":
            groups = simhash.near_duplicates(before).collect()
            assert {r.doc_id for r in docs.collect()} == {r.component_id for r in groups} and docs.count() == len({r.component_id for r in groups})
        if name == "mixing":
            want = Counter({r.doc_id: r.copies for r in mixing.mix(before).collect() if r.copies})
            assert Counter(r.doc_id for r in docs.collect()) == want
        if name == "packing":
            assert docs.agg(F.sum("length")).first()[0] == packing.pieces(before).agg(F.sum("length")).first()[0]


def test_run_is_registered(spark):
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(rows.columns)
