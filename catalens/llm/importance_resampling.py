"""Importance resampling towards a target: documents whose word runs are likelier in the target are drawn more often.

Features are hashed into buckets; the logarithm of a bucket's share in the target over its share in
the corpus is an array, from which documents are scored by place. Gumbel noise from a hash of the id
makes the highest scores a draw without replacement. The cutoff is found by bisection of the score,
then of the id among equal scores, each step an exact count over the persisted scores; only the drawn
rows are sorted, by range partitions, for their ranks.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from catalens.llm._common import materialize, scratch_scope

#: Bytes between words: all ASCII that is no digit and no lower-case letter (capitals are folded first).
_GAP = "".join(chr(i) for i in range(128) if not (48 <= i <= 57 or 97 <= i <= 122 or 65 <= i <= 90)).encode()
#: One table folds capitals and turns gaps into blanks.
FOLD = bytes(32 if i in _GAP else i + 32 if 65 <= i <= 90 else i for i in range(256))
#: Points of a bisection that are counted in one job.
POINTS = 15
#: Remembered buckets of words.
REMEMBERED = 1 << 18


def words(text: str | None) -> list[bytes]:
    """Runs of digits, letters a-z (A-Z folded) and all characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


class Buckets(dict):
    """The bucket of a feature, remembered up to a bound."""

    def __init__(self, n_buckets: int):
        super().__init__()
        self.n_buckets = n_buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[feature] = zlib.crc32(feature) % self.n_buckets
        return value

    def of(self, tokens: list[bytes], max_run: int) -> np.ndarray:
        """The buckets of all runs of 1 to ``max_run`` words, repeats included."""
        found = [np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))]
        for n in range(2, max_run + 1):
            runs = map(b" ".join, zip(*(tokens[i:] for i in range(n))))
            found.append(np.fromiter(map(self.__getitem__, runs), np.int64))
        return np.concatenate(found)


def bucket_counts(texts: DataFrame, n_buckets: int, max_run: int) -> dict[int, int]:
    """How often features of ``texts`` (text) fall in each bucket: at most ``n_buckets`` rows come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, total = Buckets(n_buckets), np.zeros(n_buckets, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                total += np.bincount(buckets.of(words(text), max_run), minlength=n_buckets)
        hit = np.flatnonzero(total)
        yield pa.record_batch([pa.array(hit), pa.array(total[hit])], names=["bucket", "n"])

    rows = texts.select(F.col("text").cast("string").alias("text")).filter("text <> ''").mapInArrow(count, "bucket long, n long")
    return {r["bucket"]: r["n"] for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def bucket_gains(source: dict[int, int], target: dict[int, int], n_buckets: int) -> np.ndarray:
    """floor(1000 * ln) of every bucket's smoothed share in the target over that in the source."""
    s, t = np.zeros(n_buckets), np.zeros(n_buckets)
    for counts, array in ((source, s), (target, t)):
        for bucket, n in counts.items():
            array[bucket] = n
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n_buckets) / ((s + 1) * (t.sum() + n_buckets)))).astype(np.int64)


def gumbel_noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 * Gumbel) from the first eight hexadecimal digits of sha256('seed:doc_id'); a null id counts as empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def scored(docs: DataFrame, gains: np.ndarray, max_run: int, seed: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of ``docs`` (doc_id, text)."""
    n_buckets = len(gains)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(n_buckets)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                tokens = words(text)
                found = buckets.of(tokens, max_run)
                rows.append((len(tokens), len(found), int(gains[found].sum()) // len(found) if len(found) else 0))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 3
            yield pa.record_batch([batch.column("doc_id"), *columns], names=["doc_id", "n_words", "n_features", "weight"])

    schema = StructType([StructField(c, LongType()) for c in ("doc_id", "n_words", "n_features", "weight")])
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(score, schema)
    return rows.withColumn("score", F.col("weight") + gumbel_noise(F.col("doc_id"), seed))


def bisect(low: int, high: int, counts: Callable[[list[int]], list[int]], wanted: int) -> int:
    """The smallest whole number of ``low`` to ``high`` under or at which ``counts`` finds ``wanted`` rows or more; at worst ``high``.

    A step counts up to POINTS numbers at once and keeps the stretch between two of them.
    """
    while low < high:
        n = min(POINTS, high - low)
        points = sorted({low + (high - low) * (i + 1) // (n + 1) for i in range(n)} - {high})
        for point, found in zip(points, counts(points)):
            if found >= wanted:
                high = point
                break
            low = point + 1
    return high


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, n_buckets: int = 10_000, max_run: int = 1, min_words: int = 20, seed: int = 2024) -> DataFrame:
    """Draw ``percent`` of the documents of at least ``min_words`` words, by likeness to ``target`` (text).

    Returns doc_id, n_features, weight, score and rank (from 1 for the highest score, ties to the
    smaller doc_id; null for rows that are not drawn) of every row of ``docs`` (doc_id, text). A null
    text has no words. A null doc_id draws its noise from the empty text and loses ties. Repeated
    rows are rows of their own, with equal noise. An empty target only flattens: common buckets weigh
    less. Other columns are ignored; an empty table gives no rows.
    """
    gains = bucket_gains(bucket_counts(docs, n_buckets, max_run), bucket_counts(target, n_buckets, max_run), n_buckets)
    with scratch_scope(docs.sparkSession) as keep:
        rows = materialize(scored(docs, gains, max_run, seed), "resample-scores")
        able = rows.filter(F.col("n_words") >= min_words)
        ends = able.agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).first()
        wanted = percent * ends["n"] // 100
        out = ["doc_id", "n_features", "weight", "score"]
        if not wanted:
            return keep(rows.select(*out, F.lit(None).cast("long").alias("rank")), "resample")

        def exact(table: DataFrame, key: Column) -> Callable[[list[int]], list[int]]:
            return lambda points: list(table.agg(*[F.count_if(key <= F.lit(p)).alias(f"n{i}") for i, p in enumerate(points)]).first())

        # the highest scores are the lowest of their negatives
        cutoff = -bisect(-ends["high"], -ends["low"], exact(able, -F.col("score")), wanted)
        above = able.filter(F.col("score") > cutoff).count()
        tied = able.filter(F.col("score") == cutoff)
        ids = tied.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("doc_id").alias("n")).first()
        missing = wanted - above
        ties = F.lit(True)  # rows without an id, too, are needed
        if missing <= ids["n"]:
            ties = F.coalesce(F.col("doc_id") <= bisect(ids["low"], ids["high"], exact(tied, F.col("doc_id")), missing), F.lit(False))
        drawn = (F.col("n_words") >= min_words) & ((F.col("score") > cutoff) | ((F.col("score") == cutoff) & ties))
        rows = rows.withColumn("drawn", drawn)
        # equal rows at the cutoff can be more than are wanted; those past the last rank are not drawn
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-wanted // 1_000_000))
        sorted_rows = rows.filter("drawn").repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
        sorted_rows = materialize(sorted_rows, "resample-drawn")
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        starts = sorted_rows.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
        within = F.row_number().over(Window.partitionBy("part").orderBy(*order, "n_features", "weight"))
        ranked = sorted_rows.join(F.broadcast(starts), "part")  # one row a part
        rank = (F.col("start") + within).cast("long")
        ranked = ranked.withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
        return keep(rows.filter("NOT drawn").select(*out, F.lit(None).cast("long").alias("rank")).unionByName(ranked.select(*out, "rank")), "resample")


def resample_sql(percent: int = 10, n_buckets: int = 10_000, min_words: int = 20, seed: int = 2024) -> str:
    """resample() with runs of one word over documents and benchmark as SQL; crc32 is a table of 256 rows, folded over a word's bytes."""
    word_list = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    shift = "list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)"
    digits = "list_transform(range(0, length(hex(w)) // 2), lambda k: CAST(('0x' || substr(hex(w), 2 * k + 1, 2)) AS BIGINT))"
    step = "list_reduce([4294967295::BIGINT] || bytes, lambda c, b: xor(c // 256, places[xor(c % 256, b) + 1]))"
    return rf"""WITH corpus AS (SELECT doc_id, {word_list} AS ws FROM documents), wanted AS (SELECT {word_list} AS ws FROM benchmark),
    byte_table AS (SELECT list(v ORDER BY i) AS places FROM (SELECT i, {shift} AS v FROM (SELECT unnest(range(256)) AS i))),
    vocabulary AS (SELECT DISTINCT unnest(ws) AS w FROM (SELECT ws FROM corpus UNION ALL SELECT ws FROM wanted)),
    hashed AS (SELECT w, xor({step}, 4294967295) % {n_buckets} AS bucket FROM (SELECT w, {digits} AS bytes FROM vocabulary), byte_table),
    in_corpus AS (SELECT bucket, count(*) AS n FROM (SELECT unnest(ws) AS w FROM corpus) JOIN hashed USING (w) GROUP BY bucket),
    in_wanted AS (SELECT bucket, count(*) AS n FROM (SELECT unnest(ws) AS w FROM wanted) JOIN hashed USING (w) GROUP BY bucket),
    gains AS (SELECT c.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM in_corpus) + {n_buckets})::DOUBLE / ((c.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM in_wanted), 0) + {n_buckets})::DOUBLE))) AS BIGINT) AS gain FROM in_corpus c LEFT JOIN in_wanted t USING (bucket)),
    word_gains AS (SELECT w, gain FROM hashed JOIN gains USING (bucket)),
    tagged AS (SELECT row_number() OVER () AS n, doc_id, ws, CAST('0x' || substr(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)::DOUBLE AS h FROM corpus),
    weights AS (SELECT n, sum(gain) AS total FROM (SELECT n, unnest(ws) AS w FROM tagged) JOIN word_gains USING (w) GROUP BY n),
    scores AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, CAST(CASE WHEN len(ws) = 0 THEN 0 ELSE floor(total::DOUBLE / len(ws)) END AS BIGINT) AS weight, CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS noise FROM tagged LEFT JOIN weights USING (n)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {min_words} ORDER BY weight + noise DESC, doc_id) AS place FROM scores)
    SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN n_features >= {min_words} AND place <= (SELECT {percent} * count(*) // 100 FROM scores WHERE n_features >= {min_words}) THEN place END AS rank FROM ranked"""
