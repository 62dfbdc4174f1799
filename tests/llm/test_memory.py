import os
import random
import subprocess
import sys

import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from tsuzuri.llm import common, components

NAME = "spark.sql.parquet.columnarReaderBatchSize"

SMALL_HEAP = """
import sys
from pyspark.sql import SparkSession
from tsuzuri.llm import soft_mixing
from tsuzuri.llm.common import settle, table
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
members = settle(soft_mixing.memberships(table(spark, sys.argv[1], "documents"), soft_mixing.fit_domains([])))
print("rows", members.count(), members.selectExpr("sum(n_tokens)").first()[0])
"""


def test_long_texts_of_many_rows_fit_a_small_heap(tmp_path):
    os.mkdir(tmp_path / "documents.parquet")
    for i in range(2):
        pq.write_table(pa.table({"doc_id": range(i * 4096, (i + 1) * 4096), "text": [f"{k} " + "word " * 8000 for k in range(4096)]}), tmp_path / f"documents.parquet/{i}.parquet", use_dictionary=False)
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--driver-memory 600m pyspark-shell"}
    got = subprocess.run([sys.executable, "-c", SMALL_HEAP, str(tmp_path)], env=env, capture_output=True, text=True, timeout=300)
    assert f"rows 8192 {8192 * 8001}" in got.stdout, got.stderr[-2000:]


def test_every_stage_reads_few_rows_at_a_time(spark, tmp_path):
    spark.createDataFrame([(1, "a clean text", "en", "s", 12)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        spark.conf.set(NAME, 4096)
        stage(spark, docs, str(tmp_path))
        assert int(spark.conf.get(NAME)) == common.READ_ROWS
    spark.conf.set(NAME, 100)
    common.read_few(spark)
    assert int(spark.conf.get(NAME)) == 100


def test_components_of_few_edges_take_one_task(spark, monkeypatch):
    rng = random.Random(9)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(300)] + [(-5, 7), (7, 7)]
    frame = spark.createDataFrame(edges, "u long, v long").repartition(5)
    written = []
    monkeypatch.setattr(components, "settle", lambda df: written.append(1) or common.settle(df))
    few = sorted(map(tuple, components.components(frame).collect()))
    assert len(written) == 2
    monkeypatch.setattr(components, "ALONE", 0)
    assert few == sorted(map(tuple, components.components(frame).collect())) and len(written) > 4
    assert components.components(frame.limit(0)).collect() == []
    monkeypatch.setattr(components, "ALONE", 1)
    assert components.components(frame.limit(0)).collect() == []
