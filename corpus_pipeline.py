"""The corpus pipeline: five stages over ``documents``, each calling one operator of the llm package.

Every stage takes (spark, docs, sf_dir) and returns the rows that go on; ``run`` writes each stage's
result as Parquet in the cluster's shared folder and reads it back as the next one's docs. All but
the last stage return the columns of documents. A stage's table is deleted once the next one stands.

Each stage's docstring says what becomes of nulls, empty texts, ties and repeated rows. Very long
texts are processed whole by all of them, an empty table stays empty with the stage's columns, and
further columns of documents go through under their own names, also where an operator uses the name;
only the last stage replaces columns named as those that it adds.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from catalens.llm._common import ARROW_BATCHES, drop_scratch, scratch_scope, table
from catalens.llm.adaptive_quality import keep_good
from catalens.llm.cgk_decontam import find_items
from catalens.llm.ngram_join import keep_one_of_each
from catalens.llm.piece_spans import piece_digests
from catalens.llm.secret_forest import redact_secrets, scan_secrets


def small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The session hands Python tasks a few MB at once from here on, as a stage's rows are made when its result is written."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for k, v in ARROW_BATCHES.items():
            spark.conf.set(k, v)
        return stage(spark, docs, sf_dir)

    return run_stage


@small_batches
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that the rules reject go.

    Null and empty texts go, as they have too few words; a null lang or source is a group of its own; rows
    of equal text, lang and source share a fate; ids are not looked at.
    """
    return keep_good(docs)


@small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join on five-word shingles at 0.8: of each group the document with the smallest id stays.

    Null and empty texts are linked with nothing and stay, as do rows with a null id; rows of one id stay
    or go together. The smallest id decides, so there are no ties.
    """
    return keep_one_of_each(docs, n=5, percent=80)


@small_batches
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a passage of the benchmark go.

    Null and empty texts hold none and stay; ids are not looked at, and every repeated row is searched;
    benchmark rows with a null id or without a word are not searched for.
    """
    return find_items(docs, table(spark, sf_dir, "benchmark"), keep="clean")


@small_batches
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: every document stays, with its secrets replaced by a mark.

    Null and empty texts stay as they are; rows of one id share their secrets, and a row with a null id
    has those of its own text; of secrets that overlap the longer one is replaced first.
    """
    return redact_secrets(docs, scan_secrets(docs))


@small_batches
def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding and decoding: the documents with the digests of their pieces, spans and decoded text.

    A null text counts as the empty one, which has no pieces; every row is encoded by itself.
    """
    return piece_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("secret_scans", secrets),
    ("sentencepiece", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        with scratch_scope(spark) as keep:  # what a stage wrote for itself goes with it
            kept = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if i:
            drop_scratch(docs)
        docs = kept
    return docs


#: Near-duplicate search at this size, edit distance and SentencePiece can't be put in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None
