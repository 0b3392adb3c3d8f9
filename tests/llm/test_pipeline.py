"""The pipeline's stages against their own brute-force versions on the smallest tables."""

import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.llm.test_corpus_operators import brute_components, brute_passages
from tests.llm.test_text_operators import base_of

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = spark.createDataFrame([(None, None, None, None, None), (900_001, "", "en", "s", 0)], docs.schema)
    kept = {"source": docs.union(extra).withColumn("shard", F.lit("clash"))}
    before = kept["source"]
    for name, stage in pipeline.STAGES[:-1]:
        stage(spark, before, FOLDER).write.parquet(str(tmp_path / name))
        kept[name] = before = spark.read.parquet(str(tmp_path / name))
        assert before.columns == kept["source"].columns
    rows = {name: [(r["doc_id"], r["text"]) for r in df.collect()] for name, df in kept.items()}

    for key, text in rows["quality_rules"]:
        n, _, _, _, repeated = base_of(text)
        assert n >= 50 and 2 * repeated <= n
    lost = {k: t for k, t in rows["source"] if k not in dict(rows["quality_rules"])}
    clean = [t for t in lost.values() if base_of(t)[0] >= 50 and 2 * base_of(t)[4] <= base_of(t)[0] and not re.search(r"###|\$\$\$| \| ", t)]
    assert not clean and set(rows["language_id"]) == set(rows["quality_rules"])

    tops, _ = brute_components(rows["language_id"])
    assert {k for k, _ in rows["near_dedup"]} == {k for k, t in tops.items() if k == t}

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    hit = {doc for doc, _ in brute_passages(rows["near_dedup"], items)}
    assert hit and {k for k, _ in rows["decontaminate"]} == {k for k, _ in rows["near_dedup"]} - hit

    packed = pipeline.STAGES[-1][1](spark, before, FOLDER).collect()
    assert {r["doc_id"] for r in packed} == {k for k, _ in rows["decontaminate"]}


def test_empty(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0
