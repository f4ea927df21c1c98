"""The corpus pipeline against a version in plain Python."""

import hashlib
import os
import random

import pytest
import sentencepiece
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from catalens.llm import adaptive_quality as Q
from catalens.llm import cgk_decontam as C
from test_operators_llm import brute_components, brute_edits, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    items = [(i, prose(rng, 30, 2000)) for i in range(5)]
    rows = []
    for i in range(300):
        words = prose(rng, rng.randrange(60, 160), 3000).split()
        if i % 10 == 1:
            words = rows[-1][1].split() + ["extra"]
        if i % 10 == 2:
            words[20:20] = items[i % 5][1].split()
        if i % 10 == 3:
            words[10:10] = ["token", "=", '"' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"']
        if i % 10 == 4:
            words = words[:20]
        if i % 10 == 5:
            words[10:10] = [str(rng.randrange(10**15, 10**16))]
        rows.append((i, " ".join(words), "en", "s", 0))
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0)]
    rows += [(700, prose(rng, 90, 3000), "en", "s", None)] * 2  # a repeated row
    loose = [(None, prose(rng, 90, 3000), None, None, None), (None, None, "en", None, 1)]
    out = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame(rows + loose, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("component_id", "kept", "score", "candidate", "n_words"):  # names that operators use
        docs = docs.withColumn(name, F.lit("clash"))
    docs.write.parquet(os.path.join(out, "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(os.path.join(out, "benchmark.parquet"))
    return str(out), rows, items


def test_pipeline_equals_brute_force(spark, folder):
    path, rows, items = folder
    good = [r for r in rows if (lambda c: c[0] >= 50 and 100 * c[4] <= 50 * c[0])(Q.text_counts(r[1]))]
    component = {d: c for d, _, c in brute_components(good, 5, 80)}
    single = [r for r in good if component[r[0]] == r[0]]
    clean = [r for r in single if not any(brute_edits(C.normal_words(t), C.normal_words(r[1])) <= int(0.2 * len(C.normal_words(t))) for _, t in items)]
    before = set(os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")))
    result = corpus_pipeline.run(spark, path)
    left = set(os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))) - before
    assert len(left) == 1 and left.pop().startswith("pipeline-sentencepiece")  # the others are deleted
    found = result.collect()
    assert all(r[c] == "clash" for r in found for c in ("component_id", "kept", "score", "candidate", "n_words"))
    assert sorted(str(r["doc_id"]) for r in found) == sorted([str(r[0]) for r in clean] + ["None"])  # the row without an id stays
    got = {r["doc_id"]: r for r in found}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    import re

    for d, text, *_ in clean:
        expected = re.sub(r'(?<=token = ")[0-9a-f]{40}', "<secret>", text)
        assert got[d]["text"] == expected
        assert got[d]["ids_sha256"] == hashlib.sha256(",".join(map(str, library.encode(expected))).encode()).hexdigest()


def test_stages_keep_the_columns(spark, folder):
    path, *_ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
