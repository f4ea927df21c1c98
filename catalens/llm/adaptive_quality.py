"""Quality rules whose thresholds adapt to each language and source.

Each document gets four rates in thousandths. Mergeable quantile sketches of the rates are kept
per (language, source): a sketch is the count of values in each bucket of six significant bits
(relative error under 1/64), so sketches of files, sources or days merge by adding counts, and
the sketches of a language and of the whole corpus are sums of the same rows. A threshold is a
fence outside the middle half of its group, and the verdict comes from joining documents with
their group's thresholds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from catalens.llm._common import materialize
from catalens.llm._text import byte_words

SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
#: Per rate: numerator, denominator, the least spread in thousandths, and whether low values are bad as well.
RATES = {
    "mean_word": ("word_chars", "n_words", 500, True),
    "symbols": ("n_symbols", "n_words", 50, False),
    "dup_lines": ("n_dup_lines", "n_lines", 120, False),
    "repeats": ("n_repeat_words", "n_words", 120, False),
}
#: A fence lies this many spreads outside the quartiles; a group's fence never goes beyond twice its
#: language's, nor a language's beyond twice the corpus's, so a group of mostly junk doesn't set its own standard.
FENCE = 3
#: Groups with fewer documents use their language's thresholds, and small languages the corpus's.
MIN_GROUP = 200
#: As many groups' thresholds may be broadcast; beyond that the join shuffles.
MAX_BROADCAST_GROUPS = 50_000


def text_counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The counts of one whole text, in the order of COUNTS; a null text has none of anything."""
    words = byte_words(text)
    n = len(words)
    if not n:
        return 0, 0, sum(map((text or "").count, SYMBOLS)), 0, 0, 0
    lines = [line for line in text.split("\n") if byte_words(line)]
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        times, last = Counter(windows), 0
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 3 - max(last, i)
                last = i + 3
    return n, len(b"".join(words).decode("utf-8", "surrogatepass")), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines)


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs`` and the COUNTS of each row's whole text; columns of these names are replaced."""
    docs = docs.drop(*COUNTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                rows = [text_counts(t) for t in part.column("text").to_pylist()]
                yield pa.record_batch([*part.columns, *[pa.array(c, pa.int64()) for c in zip(*rows)]], names=[*part.schema.names, *COUNTS])

    return docs.mapInArrow(count, StructType([*docs.schema.fields, *[StructField(c, LongType()) for c in COUNTS]]))


def rate(name: str) -> Column:
    """A rate in whole thousandths; 0 where there is nothing to divide by."""
    top, bottom, _, _ = RATES[name]
    return F.when(F.col(bottom) > 0, F.expr(f"1000 * {top} div {bottom}")).otherwise(F.lit(0)).cast("long")


def bucket(value: Column) -> Column:
    """The lower end of a value's bucket: its six highest bits below the leading one are kept."""
    low_bits = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, low_bits), low_bits)


def rate_sketches(counted: DataFrame) -> DataFrame:
    """The sketches of all documents with a word: lang, source, rate, bucket, n (rows add up under union)."""
    one = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), bucket(rate(r)).alias("bucket")) for r in RATES]))
    rows = counted.filter("n_words > 0").select("lang", "source", one.alias("x")).select("lang", "source", "x.rate", "x.bucket")
    return rows.groupBy("lang", "source", "rate", "bucket").agg(F.count("*").alias("n"))


def _quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """n, q1 and q3 of each key and rate: the buckets that hold the ceil(n/4)-th and ceil(3n/4)-th value."""
    merged = sketches.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*keys, "rate").orderBy("bucket")
    ranked = merged.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys, "rate")))
    at = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("all"), F.col("bucket")))
    return ranked.groupBy(*keys, "rate").agg(F.max("all").alias("n"), at(1).alias("q1"), at(3).alias("q3"))


def thresholds(sketches: DataFrame) -> DataFrame:
    """One row for each (lang, source) in the sketches: low_<rate> and high_<rate> in thousandths."""
    spread = F.create_map(*[F.lit(x) for r, v in RATES.items() for x in (r, v[2])])
    width = F.greatest(F.col("q3") - F.col("q1"), spread[F.col("rate")])

    def fences(df: DataFrame, tag: str) -> DataFrame:
        q1, q3 = F.col("q1"), F.col("q3")
        ends = {"low": q1 - FENCE * width, "high": q3 + FENCE * width, "widest_low": q1 - 2 * FENCE * width, "widest_high": q3 + 2 * FENCE * width}
        return df.select(*[c for c in df.columns if c in ("lang", "source", "rate")], F.col("n").alias(f"n_{tag}"), *[x.alias(f"{n}_{tag}") for n, x in ends.items()])

    group = fences(_quartiles(sketches, ["lang", "source"]), "g")
    lang = fences(_quartiles(sketches, ["lang"]), "l").withColumnRenamed("lang", "l_lang").withColumnRenamed("rate", "l_rate")
    corpus = fences(_quartiles(sketches, []), "c").withColumnRenamed("rate", "c_rate")
    both = group.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("rate") == F.col("l_rate")))
    both = both.join(F.broadcast(corpus), F.col("rate") == F.col("c_rate"))  # one row for each rate
    pick = lambda n, lang, group: F.when(F.col("n_l") < MIN_GROUP, F.col(f"{n}_c")).when(F.col("n_g") < MIN_GROUP, lang).otherwise(group)
    low = pick("low", F.greatest("low_l", "widest_low_c"), F.greatest("low_g", "widest_low_l", "widest_low_c"))
    high = pick("high", F.least("high_l", "widest_high_c"), F.least("high_g", "widest_high_l", "widest_high_c"))
    chosen = both.select("lang", "source", "rate", low.alias("low"), high.alias("high"))
    by = lambda n, r: F.max(F.when(F.col("rate") == r, F.col(n))).alias(f"{n}_{r}")
    return chosen.groupBy("lang", "source").agg(*[by(n, r) for r in RATES for n in ("low", "high")])


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """``counted`` joined with its groups' thresholds; adds base_failed and kept.

    Equal null languages or sources form groups of their own. The thresholds are broadcast only
    after a count of the groups; above MAX_BROADCAST_GROUPS the join shuffles, and a hot group is
    split by adaptive execution. A document without any word is never kept.
    """
    limits = limits.withColumnsRenamed({"lang": "__lang", "source": "__source"})
    small = limits.limit(MAX_BROADCAST_GROUPS + 1).count() <= MAX_BROADCAST_GROUPS
    joined = counted.join(F.broadcast(limits) if small else limits, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    inside = F.lit(True)
    for r, (_, _, _, two_sided) in RATES.items():
        inside &= F.coalesce(rate(r) <= F.col(f"high_{r}"), F.lit(True))
        if two_sided:
            inside &= F.coalesce(rate(r) >= F.col(f"low_{r}"), F.lit(True))
    made = joined.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & inside)
    return made.drop("__lang", "__source", *[f"{n}_{r}" for r in RATES for n in ("low", "high")])


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed and kept of every row of ``docs`` (doc_id, text, lang, source).

    A null or empty text has no words and fails; repeated rows are judged one by one; other columns
    are ignored; an empty table gives no rows.
    """
    counted = materialize(with_counts(docs.select("doc_id", "text", "lang", "source")).drop("text"), "quality-counts")
    limits = materialize(thresholds(materialize(rate_sketches(counted), "quality-sketches")), "quality-limits")
    return judge(counted, limits)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (text, lang, source, any others) that quality_verdicts() keeps, with the columns of ``docs``.

    Texts are not shuffled, but read and counted once for the sketches and once for the verdict. A null
    or empty text goes; equal rows share a fate; columns named as the operator's own stay as they are; an
    empty table stays empty.
    """
    sketches = materialize(rate_sketches(with_counts(docs.select("text", "lang", "source")).drop("text")), "quality-sketches")
    limits = materialize(thresholds(sketches), "quality-limits")
    inner = [c if c in ("text", "lang", "source") else f"__own{i}" for i, c in enumerate(docs.columns)]
    kept = judge(with_counts(docs.toDF(*inner)), limits).filter("kept")
    return kept.select(*[F.col(x).alias(c) for x, c in zip(inner, docs.columns)])


def _counts_sql() -> str:
    return r"""
    d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
    p AS (SELECT rid, unnest(range(1, len(words) - 1)) AS i, unnest(list_zip(words[1:len(words) - 2], words[2:len(words) - 1], words[3:])) AS x FROM w WHERE len(words) > 2),
    g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS times FROM p),
    r AS (SELECT rid, count(DISTINCT i + j) AS n_repeat_words FROM g, (VALUES (0), (1), (2)) AS t(j) WHERE times > 1 GROUP BY rid),
    c AS (SELECT w.rid, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
                 CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                 CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                 coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines
          FROM w LEFT JOIN r USING (rid))"""


def _rates_sql() -> str:
    branches = " UNION ALL ".join(f"SELECT rid, lang, source, '{r}' AS rate, CASE WHEN {b} > 0 THEN 1000 * {t} // {b} ELSE 0 END AS v, {s} AS spread, {str(two).lower()} AS two FROM c WHERE n_words > 0" for r, (t, b, s, two) in RATES.items())
    return f"x AS ({branches}), s AS (SELECT *, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) AS bucket FROM x)"


def _fences_sql(tag: str, keys: list[str]) -> str:
    by = "".join(f"{k}, " for k in keys)
    return f"""{tag}q AS (SELECT {by} rate, any_value(spread) AS spread, count(*) AS n, list_sort(list(bucket)) AS b FROM s GROUP BY {by} rate),
    {tag} AS (SELECT {by} rate, n, b[(n + 3) // 4] AS q1, b[(3 * n + 3) // 4] AS q3, greatest(b[(3 * n + 3) // 4] - b[(n + 3) // 4], spread) AS width FROM {tag}q)"""


def verdict_sql(select: str = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept") -> str:
    """DuckDB SQL over ``documents`` for the rows of quality_verdicts()."""
    return f"""WITH {_counts_sql()}, {_rates_sql()}, {_fences_sql('fg', ['lang', 'source'])}, {_fences_sql('fl', ['lang'])}, {_fences_sql('fc', [])},
    f AS (SELECT fg.lang, fg.source, fg.rate,
        CASE WHEN fl.n < {MIN_GROUP} THEN fc.q1 - {FENCE} * fc.width WHEN fg.n < {MIN_GROUP} THEN greatest(fl.q1 - {FENCE} * fl.width, fc.q1 - {2 * FENCE} * fc.width) ELSE greatest(fg.q1 - {FENCE} * fg.width, fl.q1 - {2 * FENCE} * fl.width, fc.q1 - {2 * FENCE} * fc.width) END AS low,
        CASE WHEN fl.n < {MIN_GROUP} THEN fc.q3 + {FENCE} * fc.width WHEN fg.n < {MIN_GROUP} THEN least(fl.q3 + {FENCE} * fl.width, fc.q3 + {2 * FENCE} * fc.width) ELSE least(fg.q3 + {FENCE} * fg.width, fl.q3 + {2 * FENCE} * fl.width, fc.q3 + {2 * FENCE} * fc.width) END AS high
        FROM fg JOIN fl ON fg.lang IS NOT DISTINCT FROM fl.lang AND fg.rate = fl.rate JOIN fc ON fg.rate = fc.rate),
    bad AS (SELECT DISTINCT rid FROM s JOIN f ON s.lang IS NOT DISTINCT FROM f.lang AND s.source IS NOT DISTINCT FROM f.source AND s.rate = f.rate WHERE v > high OR (two AND v < low)),
    judged AS (SELECT c.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND bad.rid IS NULL AS kept FROM c LEFT JOIN bad USING (rid))
    SELECT {select} FROM judged"""
