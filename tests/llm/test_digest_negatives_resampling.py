"""Quartile digests, hard negatives and importance resampling against brute force, with every kind of odd row."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalens.llm import hard_negatives as H
from catalens.llm import importance_resampling as R
from catalens.llm import quartile_digest as D
from catalens.llm._common import materialize, scratch_scope


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


# ---- 11: quartile digests ----------------------------------------------------------------------


def slow_digest(text):
    raw = (text or "").encode()
    counts = Counter()
    for stride in (1, 2, 3):
        for i in range(len(raw) - 2 * stride):
            h = (raw[i] << 16 | raw[i + stride] << 8 | raw[i + 2 * stride]) + stride * 0x1000193
            h = h * 0x9E3779B1 % 2**32
            h = (h ^ h >> 15) * 0x85EBCA77 % 2**32
            counts[h >> 24] += 1
    ordered = sorted(counts[b] for b in range(256))
    q1, q2, q3 = ordered[63], ordered[127], ordered[191]
    codes = "".join(f"{sum(counts[b] > q for q in (q1, q2, q3)):02b}" for b in range(256))
    head = f"{int(8 * math.log2(len(raw) + 1)):02x}" + "".join(f"{15 * q // q3 if q3 else 0:x}" for q in (q1, q2))
    return head + f"{int(codes, 2):0128x}"


@pytest.mark.parametrize("text", [None, "", "a", "ab", "abc", "abcdefg", "é中文ß", "x" * 500, prose(random.Random(1), 3000)])
def test_digest_counts_triplets(text):
    assert D.digest(text) == slow_digest(text)
    assert D.difference(D.digest(text), D.digest(text)) == 0


def test_digest_is_whole_over_chunks(monkeypatch):
    text = prose(random.Random(2), 4000)
    whole = D.digest(text)
    monkeypatch.setattr(D, "CHUNK", 777)
    assert D.digest(text) == whole


def test_difference_is_bounded_and_symmetric():
    rng = random.Random(3)
    marks = [D.digest(prose(rng, n)) for n in (0, 1, 5, 50, 500, 5000)] + ["ff" + "ff" + "f" * 128, "00" + "00" + "0" * 128]
    for a in marks:
        for b in marks:
            assert 0 <= D.difference(a, b) == D.difference(b, a) <= D.MAX_DIFFERENCE
    assert D.likeness(marks[-1], marks[-2]) == 0.0


def slow_edits(rows):
    """Rows by descending id (none last), then by the hash of the text, each with the next."""
    out = []
    for i, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(text) // 3
        changed = text[: len(text) - k] + following[:k]
        a, b, c = D.digest(text), D.digest(changed), D.digest(following)
        out.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), a, b, D.likeness(a, b), D.likeness(a, c)))
    return out


def in_order(spark, rows):
    """Rows in the documented order: descending id without nulls, then descending hash of the text, as Spark sees it."""
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    return [(r[0], r[1]) for r in df.orderBy(F.desc_nulls_last("doc_id"), F.desc("tie")).collect()]


@pytest.mark.parametrize("part_bytes", [300, 5000, 1 << 25])
def test_edits_against_brute_force(spark, part_bytes):
    rng = random.Random(5)
    same = prose(rng, 40)
    rows = [(i, prose(rng, rng.choice([0, 1, 3, 30, 200]))) for i in range(60)]
    rows += [(100 + i, same) for i in range(20)] + [(7_000_000_000, None), (-5, "é中文" * 9), (None, "no id"), (None, prose(rng, 9)), (200, prose(rng, 20_000, 3000))]
    rows += [(50, prose(rng, 12)) for _ in range(80)] + [(55, same), (55, same), (55, same)]  # one id holds a third
    rng.shuffle(rows)
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, part string, guest int").repartition(7)
    got = D.edit_likeness(docs, part_bytes=part_bytes).collect()
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(key, got)) == sorted(map(key, slow_edits(in_order(spark, rows))))


def test_edits_of_one_row_and_none(spark):
    schema = "doc_id long, text string"
    assert D.edit_likeness(spark.createDataFrame([], schema)).count() == 0
    (r,) = D.edit_likeness(spark.createDataFrame([(1, "abcdef")], schema)).collect()
    assert r["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and r["near_next"] == 1.0


def test_an_edit_is_nearer_than_another_document(spark, sf_dir):
    rows = D.edit_likeness(spark.read.parquet(f"{sf_dir}/documents.parquet")).filter("n_chars > 0").collect()
    differ = [r for r in rows if r["near_next"] < 1]
    assert sum(r["near_edited"] > r["near_next"] for r in differ) >= 0.99 * len(differ)


def test_digest_columns(spark):
    df = spark.createDataFrame([("one text", "one text"), (None, "other")], "a string, b string")
    got = df.select(D.digest_likeness(D.fingerprint(F.col("a")), D.fingerprint(F.col("b"))).alias("x"), D.digest_likeness(F.col("a"), F.lit(None).cast("string")).alias("y")).collect()
    assert got[0]["x"] == 1.0 and got[0]["y"] is None and got[1]["x"] < 1.0


# ---- 12: hard negatives ------------------------------------------------------------------------


def slow_negatives(rows, anchor, k=5):
    usable = {}
    for vec_id, vector, label in rows:
        if None in (vec_id, vector, label) or any(x is None or not math.isfinite(x * 256) for x in vector):
            continue
        usable.setdefault(vec_id, set()).add((label, tuple(math.floor(256 * x) for x in vector)))
    out = []
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    for vec_id in filter(anchor, usable):
        label, v = min(usable[vec_id], key=lambda x: (x[0], x[1]))
        best = lambda keep: sorted(((-max(score(v, w) for l, w in u if keep(l)), i) for i, u in usable.items() if any(keep(l) for l, _ in u)))
        positives = [(i, -s) for s, i in best(lambda l: l == label) if i != vec_id][:k]
        for positive, p in positives:
            fits = sorted((-s, i) for i, u in usable.items() for s in [max((score(v, w) for l, w in u if l != label and 80 * p <= 100 * score(v, w) <= 100 * p), default=None)] if s is not None)[:k]
            out += [(vec_id, positive, rank + 1, i, p, -s) for rank, (s, i) in enumerate(fits)]
    return sorted(out)


def odd_vectors(rng, n, d):
    rows = [(i, [rng.gauss(0.1, 0.3) for _ in range(d)], rng.randrange(3)) for i in range(n)]
    same = [0.25] * d
    rows += [(1000 + i, same, i % 2) for i in range(60)]  # a common vector: ties by id
    rows += [(2000, None, 1), (2001, same, None), (None, same, 1), (2002, [float("nan")] * d, 1), (2003, [float("inf")] + same[1:], 1), (2004, [None] + same[1:], 1)]
    rows += [(20, rows[20][1], rows[20][2]), (21, rows[21][1], rows[21][2]), (2010, [0.0] * d, 0), (2020, [-1e-30] * d, 1)]
    return rows


@pytest.mark.parametrize("block", [7, 50, 1 << 16])
def test_negatives_against_brute_force(spark, block):
    rng = random.Random(block)
    rows = odd_vectors(rng, 150, 6)
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, score string").repartition(3)
    got = H.hard_negatives(H.whole_vectors(frame), F.col("vec_id") % 10 == 0, block_rows=block)
    assert sorted(map(tuple, got.collect())) == slow_negatives(rows, lambda i: i % 10 == 0)


def test_negatives_of_large_and_uneven_vectors(spark):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-1, 1) * 10 ** rng.choice([0, 6]) for _ in range(rng.choice([2, 4]))], i % 2) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = H.hard_negatives(H.whole_vectors(frame), F.col("vec_id") % 5 == 0, block_rows=13)
    assert sorted(map(tuple, got.collect())) == slow_negatives(rows, lambda i: i % 5 == 0)


def test_negatives_of_nothing(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert H.hard_negatives(H.whole_vectors(frame), F.col("vec_id") % 10 == 0).count() == 0


def test_threshold_stops_early_and_exactly():
    rng = np.random.default_rng(1)
    vectors = np.floor(256 * rng.pareto(1.5, (20_000, 3)))  # few rows dominate
    lists = H.Lists(np.arange(20_000), np.zeros(20_000, int), vectors)
    anchor = np.array([3.0, 2.0, 1.0])
    (found,), scored = lists.search(anchor, [(None, None)], 5, np.ones(20_000, bool))
    scores = vectors @ anchor
    order = np.lexsort((np.arange(20_000), -scores))[:5]
    assert found == [(int(scores[i]), int(i)) for i in order]
    assert scored < 2_000
    # a window in the middle: stops at its lower end
    low, high = int(np.quantile(scores, 0.98)), int(np.quantile(scores, 0.99))
    (found,), scored = lists.search(anchor, [(low, high)], 5, np.ones(20_000, bool))
    fits = [i for i in np.lexsort((np.arange(20_000), -scores)) if low <= scores[i] <= high][:5]
    assert found == [(int(scores[i]), int(i)) for i in fits] and scored < 20_000


# ---- 13: importance resampling -----------------------------------------------------------------


def slow_resample(docs, target, percent, n_buckets, min_words):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    place = lambda w: zlib.crc32(w.encode()) % n_buckets
    s, t = (Counter(place(w) for text in texts for w in split(text)) for texts in ([x[1] for x in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + n_buckets) / ((s[b] + 1) * (T + n_buckets))))
    rows = []
    for doc_id, text in docs:
        ws = split(text)
        weight = sum(gain(place(w)) for w in ws) // len(ws) if ws else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(ws), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return sorted(map(str, rows))


@pytest.mark.parametrize("percent", [0, 1, 10, 37, 100])
def test_resample_against_brute_force(spark, percent):
    rng = random.Random(percent)
    docs = [(i, prose(rng, rng.choice([0, 5, 19, 20, 40]), 60)) for i in range(120)]
    same = prose(rng, 30, 60)
    docs += [(500, same)] * 30 + [(None, same), (None, same), (None, None), (501, None), (502, "É ß 中文 A-B_c9 \x7f x" * 7), (503, prose(rng, 20_000, 900))]
    target = [prose(rng, 50, 20), None, ""]
    frame = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, score int, rank int")
    got = R.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent, n_buckets=50)
    assert sorted(str(list(r)) for r in got.collect()) == slow_resample(docs, target, percent, 50, 20)


def test_resample_breaks_ties_by_id(spark, monkeypatch):
    monkeypatch.setattr(R, "gumbel_noise", lambda doc_id, seed: F.lit(0).cast("long"))
    text = " ".join(["same"] * 25)
    docs = spark.createDataFrame([(i * 1_000_003 % 10_007 - 5000, text) for i in range(1000)], "doc_id long, text string")
    got = R.resample(docs, docs.select("text")).filter("rank IS NOT NULL").orderBy("rank").collect()
    ids = sorted(r[0] for r in docs.select("doc_id").collect())
    assert [r["doc_id"] for r in got] == ids[:100] and [r["rank"] for r in got] == list(range(1, 101))


def test_resample_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert R.resample(none, none.select("text")).count() == 0


def test_runs_of_words():
    buckets = R.Buckets(1000)
    found = buckets.of([b"a", b"b", b"c"], 2)
    assert found.tolist() == [zlib.crc32(w) % 1000 for w in (b"a", b"b", b"c", b"a b", b"b c")]
    assert R.Buckets(10).of([], 3).tolist() == []


@pytest.mark.parametrize("wanted", [1, 2, 500, 999, 1000, 2000])
def test_bisect(wanted):
    values = sorted(random.Random(9).randrange(-10**12, 10**12) for _ in range(1000))
    count = lambda points: [sum(v <= p for v in values) for p in points]
    assert R.bisect(values[0], values[-1], count, wanted) == values[min(wanted, 1000) - 1]


# ---- scratch -----------------------------------------------------------------------------------


def test_scratch_scopes_are_a_threads_own(spark):
    from concurrent.futures import ThreadPoolExecutor

    with scratch_scope(spark), ThreadPoolExecutor(1) as other:
        mine = materialize(spark.range(3), "mine")
        its = other.submit(lambda: materialize(spark.range(5), "its")).result()
        assert mine.count() == 3
    assert its.count() == 5
    with pytest.raises(Exception):
        mine.count()
