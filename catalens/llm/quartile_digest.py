"""Document fingerprints: quartile bucket digests and their bounded difference.

A digest counts the text's byte triplets (three bytes side by side, and with gaps of one and two
bytes) in BUCKETS hash buckets and keeps of each count only the quartile it lies in, besides the
length and the ratios of the quartiles. Texts that share most of their triplets have digests that
differ in few places, whatever the texts' lengths. Counts add up over chunks of a text, so a text
of any length is counted whole in bounded memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalens.llm._common import materialize

#: Hash buckets; a digest has two bits for each.
BUCKETS = 256
#: Distances between a triplet's bytes.
STRIDES = (1, 2, 3)
#: Bytes counted at once.
CHUNK = 1 << 20
#: Steps of the length code in an octave.
LENGTH_STEPS = 8
#: Points of two opposite codes of a bucket (neighbours: 1, two apart: 2).
OPPOSITE = 6
#: Points of one step of the length and of a quartile ratio; lengths of LENGTH_CAP steps apart count as far as can be.
LENGTH_POINTS, LENGTH_CAP, RATIO_POINTS = 4, 32, 4
MAX_DIFFERENCE = OPPOSITE * BUCKETS + LENGTH_POINTS * LENGTH_CAP + RATIO_POINTS * 15 * 2


def triplet_counts(raw: bytes) -> np.ndarray:
    """How many triplets of ``raw`` fall in each bucket."""
    counts = np.zeros(BUCKETS, np.int64)
    data = np.frombuffer(raw, np.uint8)
    for stride in STRIDES:
        last = 2 * stride
        for at in range(0, max(0, len(data) - last), CHUNK):
            b = data[at : at + CHUNK + last].astype(np.uint32)
            m = len(b) - last
            triplet = (b[:m] << np.uint32(16)) | (b[stride : stride + m] << np.uint32(8)) | b[last:]
            hashed = (triplet + np.uint32(stride * 0x1000193)) * np.uint32(0x9E3779B1)
            hashed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x85EBCA77)
            counts += np.bincount(hashed >> np.uint32(24), minlength=BUCKETS)
    return counts


def digest(text: str | None) -> str:
    """The fingerprint of a text (null: empty): length code, two ratios and quartile codes in hexadecimal."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = triplet_counts(raw)
    ordered = np.sort(counts)
    q1, q2, q3 = (int(ordered[BUCKETS * i // 4 - 1]) for i in (1, 2, 3))
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = codes.reshape(-1, 4) @ np.array([64, 16, 4, 1], np.uint8)
    length = min(255, int(LENGTH_STEPS * np.log2(len(raw) + 1)))
    ratios = [15 * q // q3 if q3 else 0 for q in (q1, q2)]
    return f"{length:02x}{ratios[0]:x}{ratios[1]:x}" + packed.astype(np.uint8).tobytes().hex()


#: Points of two packed bytes (four codes each), by their values.
_PAIRS = (np.arange(256)[:, None] >> np.array([6, 4, 2, 0])) & 3
_APART = np.abs(_PAIRS[:, None, :] - _PAIRS[None, :, :])
_POINTS = np.where(_APART == 3, OPPOSITE, _APART).sum(axis=2).astype(np.int64)


def difference(a: str, b: str) -> int:
    """How far two digests are apart: 0 (equal) to MAX_DIFFERENCE."""
    x, y = (np.frombuffer(bytes.fromhex(d[4:]), np.uint8) for d in (a, b))
    length = min(LENGTH_CAP, abs(int(a[:2], 16) - int(b[:2], 16)))
    ratios = sum(abs(int(a[i], 16) - int(b[i], 16)) for i in (2, 3))
    return int(_POINTS[x, y].sum()) + LENGTH_POINTS * length + RATIO_POINTS * ratios


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 for those as different as can be."""
    return 1.0 - difference(a, b) / MAX_DIFFERENCE


def fingerprint(text: Column) -> Column:
    """The digest of a text column (null: the empty text's)."""

    @F.pandas_udf("string")
    def made(texts: pd.Series) -> pd.Series:
        return texts.map(digest)

    return made(text)


def digest_likeness(a: Column, b: Column) -> Column:
    """The likeness of two digest columns; null where either is."""

    @F.pandas_udf("double")
    def compared(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else likeness(p, q) for p, q in zip(x, y)], dtype="float64")

    return compared(a, b)


def edited(text: str, following: str) -> str:
    """``text`` with its last third (in code points, rounded down) replaced by the first as many of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _bucket(key: Column, tie: Column, cuts: list[int]) -> Column:
    """The number of ``cuts`` (ascending) under ``key``; a key that is several cuts is spread over them by ``tie``.

    Buckets follow the order of (key, tie). Two steps of about the root of the number of cuts.
    """
    if not cuts:
        return F.lit(0)
    width = max(1, round(len(cuts) ** 0.5))
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    array = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    under = lambda xs: F.size(F.filter(xs, lambda x: x < key))
    coarse = under(array([g[-1] for g in groups]))
    fine = F.get(F.array(*[array(g) for g in groups]), coarse)
    place = coarse * width + F.coalesce(F.when(fine.isNotNull(), under(fine)), F.lit(0))
    hot = [x for x in dict.fromkeys(cuts) if cuts.count(x) > 1] if len(set(cuts)) < len(cuts) else []
    if not hot:
        return place
    share = (tie.cast("double") / F.lit(2.0**64) + 0.5) * F.element_at(F.create_map(*[v for x in hot for v in (F.lit(x).cast("long"), F.lit(cuts.count(x) + 1))]), key)
    return place + F.when(key.isin(hot), F.least(F.floor(share), F.lit(max(map(cuts.count, hot))))).otherwise(0).cast("int")


def edit_likeness(docs: DataFrame, part_bytes: int = 32 << 20, max_parts: int = 20_000) -> DataFrame:
    """Every document with its digest, its edited text's digest, and how alike digests are.

    ``docs`` has doc_id (whole numbers) and text. The edited text has its last third replaced by the
    start of the next document in descending order of doc_id (after the last: the first). Returns
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited (likeness to the
    edited text's digest) and near_next (to the next document's).

    A null text counts as empty; rows without a doc_id come last; rows of one doc_id follow a hash of
    their text, repeated rows each other. A single row is its own next document. Other columns are
    ignored; an empty table gives no rows.

    Rows are divided by doc_id into parts of about ``part_bytes`` (at most ``max_parts``) and sorted in
    them; the first text of each part also goes to the part before it. Texts are shuffled once; a
    task holds a batch of them.
    """
    lowest = F.lit(-(1 << 63)).cast("long")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumns({"key": F.coalesce("doc_id", lowest), "tie": F.xxhash64("text")})
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    parts = max(1, min(max_parts, max(-(-size // part_bytes), docs.sparkSession.sparkContext.defaultParallelism)))
    shares = [i / parts for i in range(1, parts)]
    cuts = sorted(rows.agg(F.percentile_approx("key", shares, 20 * parts)).first()[0] or []) if shares else []
    rows = rows.withColumn("part", _bucket(F.col("key"), F.col("tie"), cuts))
    # the first row of every part (one row a part), and the part before it in the order of the rows
    firsts = rows.groupBy("part").agg(F.max(F.struct("key", "tie")).alias("first"))
    downward = Window.orderBy(F.desc("part"))
    end = F.min("part").over(Window.orderBy(F.lit(0)))
    firsts = materialize(firsts.select("part", "first", F.coalesce(F.lag("part").over(downward), end).alias("guest_of")), "digest-firsts")
    here = F.struct(F.col("part"), F.lit(0).alias("guest"))
    there = F.struct(F.col("guest_of").alias("part"), F.lit(1).alias("guest"))
    is_first = F.struct("key", "tie") == F.col("first")
    placed = rows.join(F.broadcast(firsts), "part")  # one row a part
    placed = placed.withColumn("at", F.explode(F.when(is_first, F.array(here, there)).otherwise(F.array(here))))
    placed = placed.select("at.part", "at.guest", "key", "tie", "doc_id", "text")
    ordered = placed.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", "guest", F.desc("key"), F.desc("tie"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        open_row = None  # the row before, which waits for its next document: (part, doc_id, text, digest)
        closed = None  # the part whose rows all are out
        for batch in batches:
            out = []
            for part, guest, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "guest", "doc_id", "text"))):
                if part == closed:  # equal first rows come as several guests
                    continue
                mark = digest(text)
                if open_row is not None:
                    _, its_id, its_text, its_mark = open_row
                    changed = edited(its_text, text)
                    changed_mark = digest(changed)
                    out.append((its_id, len(its_text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), its_mark, changed_mark, likeness(its_mark, changed_mark), likeness(its_mark, mark)))
                open_row, closed = (None, part) if guest else ((part, doc_id, text, mark), closed)
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return ordered.select("part", "guest", "doc_id", "text").mapInArrow(compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
