"""What tasks and scratch tables hold: batches of rows, shuffled files, threads."""

from __future__ import annotations

import subprocess
import sys

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from catalens.llm._common import materialize


def _batch_bytes():
    def measure(batches):  # nested, as workers can't import this module
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes], pa.int64())], names=["n"])

    return measure


def _shuffle_files(spark) -> int:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def _long_texts(spark):
    return spark.range(0, 400, 1, 1).select(F.expr("repeat('x', 50000)").alias("text"))  # 20 MB in one partition


def test_materialize_hands_tasks_a_few_mb_at_once_and_restores_the_setting(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.unset(key)
    usual = spark.conf.get(key)
    made = materialize(_long_texts(spark).mapInArrow(_batch_bytes(), "n long"), "batches")
    assert max(r.n for r in made.collect()) < 6 << 20
    assert spark.conf.get(key) == usual
    spark.conf.set(key, before)


def test_a_scratch_table_leaves_no_shuffled_files(spark):
    before = _shuffle_files(spark)
    made = materialize(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "shuffled")
    assert {r.k: r["count"] for r in made.collect()} == {k: len(range(k, 1000, 7)) for k in range(7)}
    assert _shuffle_files(spark) <= before


def test_pipeline_stages_hand_tasks_a_few_mb_at_once(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.unset(key)
    stage = corpus_pipeline.small_batches(lambda spark, docs, sf_dir: docs.mapInArrow(_batch_bytes(), "n long"))
    assert max(r.n for r in stage(spark, _long_texts(spark), "").collect()) < 6 << 20
    spark.conf.set(key, before)


def test_the_token_coder_starts_no_threads():
    code = """
import os, public_tokenizers
from catalens.llm.token_frames import coder
threads = lambda: len(os.listdir("/proc/self/task"))
ours = coder(public_tokenizers.path("byte_bpe_50k.json"))
before = threads()
ours.encode([" ".join(f"w{i}x{k}" for k in range(200)) for i in range(50)])
print(threads() - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert int(out.stdout) == 0
