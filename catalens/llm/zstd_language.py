"""Language identification by compression.

A text is written in the language whose dictionary compresses it best. Each learned language has a
raw-content zstandard dictionary made of training texts; a text is compressed once with each, and
the smallest result wins. The margin to the runner-up decides the score and whether the prediction
is rejected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

UNDETERMINED = "und"
#: Bound of the training sample: so many documents of each language, in order of a hash of the id,
#: and of their text so many bytes in the dictionary. Every language is learned.
SAMPLE_DOCS, DICTIONARY_BYTES = 256, 96 << 10
#: The range of the hash that orders ids; the sample is looked for in the share of it that should hold SPARE times as many.
HASHES, SPARE = 1 << 30, 4
#: The compression level of every text, short or long.
LEVEL = 6
#: A margin (runner-up's size over the winner's, less 1) below this is too narrow.
MIN_MARGIN = 0.02
#: The margin at which the score reaches one half.
HALF_SCORE_MARGIN = 0.05

_NOT_LETTERS = regex.compile(r"\P{L}+")


def letters(text: str) -> bytes:
    """What is compressed: the text's letters in lower case, with one blank for anything between."""
    return _NOT_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "ignore")


def learn_dictionaries(docs: DataFrame, learn: Column) -> dict[str, bytes]:
    """A dictionary for each language among the rows of ``docs`` (doc_id, text, lang) where ``learn`` holds.

    Only texts with a letter and a language count. The sample is bounded by SAMPLE_DOCS ids and
    DICTIONARY_BYTES bytes a language; its rows are found by id, in the order of a hash (ties: by id),
    before any text is read. Repeated ids are one, a null id counts as an id, rows of one id come in
    the order of their texts. An empty table gives no dictionary.
    """
    usable = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return {}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(HASHES))
    # so few ids of a language are left that ranking them takes no large task
    most = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, max(1, HASHES * SPARE * SAMPLE_DOCS // n))])
    few = usable.select("lang", "doc_id", place.alias("place")).filter(F.col("place") < most[F.col("lang")]).distinct()
    order = Window.partitionBy("lang").orderBy("place", "doc_id")
    chosen = few.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= SAMPLE_DOCS).drop("place").withColumnsRenamed({"lang": "__lang", "doc_id": "__id"})
    same = (F.col("lang") == F.col("__lang")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    texts = usable.select("lang", "doc_id", "text").join(F.broadcast(chosen), same).select("lang", "rank", "text")  # SAMPLE_DOCS ids a language at most
    size = F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy("rank", "text").rowsBetween(Window.unboundedPreceding, -1))
    # a text that begins past the bound is not needed; the last one is cut at the bound
    needed = texts.withColumn("before", F.coalesce(size, F.lit(0))).filter(F.col("before") < 2 * DICTIONARY_BYTES)
    words: dict[str, list[bytes]] = {}
    for r in needed.select("lang", F.substring("text", 1, 2 * DICTIONARY_BYTES).alias("text")).orderBy("lang", "rank", "text").toLocalIterator():
        words.setdefault(r["lang"], []).extend(letters(r["text"]).split())
    # a word goes only to the language that has it most often, as texts also quote other languages
    shares = {lang: {w: n / len(ws) for w, n in Counter(ws).items()} for lang, ws in words.items()}
    most: dict[bytes, float] = {}
    for share in shares.values():
        for w, x in share.items():
            most[w] = max(x, most.get(w, 0.0))
    # the most frequent language comes first, so that it wins ties
    return {lang: b" ".join([w for w in words[lang] if 2 * shares[lang][w] >= most[w]])[:DICTIONARY_BYTES] for lang in sorted(words, key=lambda k: (-counts[k], k))}


def score(sizes: list[int]) -> tuple[int, float, float]:
    """The place of the smallest size (the first of equals), its margin, and a score from 0 to 1."""
    best = min(range(len(sizes)), key=sizes.__getitem__)
    others = [s for i, s in enumerate(sizes) if i != best]
    margin = min(others) / max(1, sizes[best]) - 1 if others else 1.0
    return best, margin, margin / (margin + HALF_SCORE_MARGIN)


def compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=False, write_content_size=False, write_dict_id=False)


def predict_languages(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """``docs`` with lang_pred, score and rejected; only the column text is looked at.

    lang_pred is the language of the smallest compression (ties: the first in ``dictionaries``),
    or ``und`` with score 0 where the text is null or has no letter, or nothing was learned.
    ``rejected`` marks those and margins under MIN_MARGIN. Whole texts are compressed. Columns of
    the three names in ``docs`` are replaced.
    """
    made = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())]
    docs = docs.drop(*[f.name for f in made])
    names = list(dictionaries)
    contents = [dictionaries[n] for n in names]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = [compressor(raw, LEVEL) for raw in contents]
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                rows = []
                for text in part.column("text").to_pylist():
                    plain = letters(text) if text else b""
                    if not plain or not names:
                        rows.append((UNDETERMINED, 0.0, True))
                        continue
                    best, margin, value = score([len(c.compress(plain)) for c in compressors])
                    rows.append((names[best], value, margin < MIN_MARGIN))
                yield pa.record_batch([*part.columns, *[pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.float64(), pa.bool_()))]], names=[*part.schema.names, *[f.name for f in made]])

    return docs.mapInArrow(predict, StructType([*docs.schema.fields, *made]))
