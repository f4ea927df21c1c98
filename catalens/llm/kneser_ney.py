"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and read through memory maps.

Counting. An n-gram is a row of 48-bit word hashes. Each task packs its distinct n-grams and their
counts into binary blocks per bucket of the n-gram's hash, so that a block row, not a row per n-gram,
is shuffled; a bucket's blocks are merged in one task, and buckets are as many as keep one small. The
n-grams of order k - 1 are the distinct endings of those of order k, counted by how many they end
(continuation counts). Every order's contexts give the numbers that interpolation needs: their total
and how many n-grams follow once, twice and more often.

Storing. Each order is a pair of sorted arrays of hashes with counts beside them (n-grams and
contexts), written as one file of arrays per bucket; buckets are ranges of the hash, so the files
of an order, in order, are one sorted array. Workers map the files and look up whole batches at once.

Scoring. p_k(w | c) = max(count - D_k(count), 0) / total(c) + weight(c) * p_(k-1)(w | shorter c), down
to the uniform distribution over the vocabulary and one unknown word; D_k(1), D_k(2), D_k(3+) come
from each order's counts of counts. Texts are scored word by word with one end each; what
precedes a text's first word is a start mark.
"""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from catalens.llm._blobs import attempt_name, open_folder
from catalens.llm._common import drop_scratch, materialize, scratch_path
from catalens.llm._text import WordHashes, folded_words, mix

HASH_BITS = 48
MASK = np.uint64((1 << HASH_BITS) - 1)
#: Hashes of the start mark and of the end, which no word is given.
START, END = np.uint64(0), np.uint64(1)
#: Words that a task gathers before it packs its n-grams.
GATHER_WORDS = 3 << 20
#: Distinct n-grams that a bucket should hold, by which the number of buckets is chosen from the words.
BUCKET_GRAMS = 2_000_000
#: Words that are scored at once.
BATCH_WORDS = 1 << 18

_codec = zstandard.ZstdCompressor(level=1)


def text_words(text: str | None, hashes: WordHashes) -> np.ndarray:
    """The words' hashes and the end's."""
    h = hashes.of(folded_words(text)) & MASK
    return np.concatenate([np.where(h < 2, h + np.uint64(2), h), [END]])


def padded(arrays: list[np.ndarray], order: int) -> np.ndarray:
    """All n-grams of ``order`` that end at a word or end of the texts, one row each; starts are padded."""
    lead = np.full(order - 1, START, np.uint64)
    flat = np.concatenate([x for a in arrays for x in (lead, a)])
    real = np.concatenate([x for a in arrays for x in (np.zeros(order - 1, bool), np.ones(len(a), bool))])
    ends = np.flatnonzero(real)
    return np.stack([flat[ends - order + 1 + k] for k in range(order)], axis=1)


def gram_hash(grams: np.ndarray) -> np.ndarray:
    """One 48-bit hash for each row; a single word's is the word's own."""
    if grams.shape[1] == 0:
        return np.zeros(len(grams), np.uint64)
    key = grams[:, 0]
    for k in range(1, grams.shape[1]):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + grams[:, k] + np.uint64(k))
    return key & MASK


def sum_by_key(columns: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct rows of ``columns`` in ascending order of the first (then the second ...) and the sums of their values."""
    order = np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0], kind="stable")
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    starts = np.flatnonzero(new)
    return [c[starts] for c in columns], [np.add.reduceat(v[order], starts) if len(starts) else v[:0] for v in values]


def pack(columns: list[np.ndarray], values: list[np.ndarray]) -> bytes:
    """Columns of 48-bit hashes (the first ascending) and counts, six and up to eight bytes a value, compressed."""
    parts = []
    for k, c in enumerate(columns):
        c = np.diff(c, prepend=np.uint64(0)) if k == 0 else c
        parts.append(np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes())
    parts += [np.ascontiguousarray(v.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for v in values]
    return _codec.compress(b"".join(parts))


def unpack(block: bytes, n: int, n_columns: int, n_values: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8)
    columns, at = [], 0
    for k in range(n_columns):
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :6] = raw[at : at + 6 * n].reshape(6, n).T
        c = wide.view("<u8").reshape(n)
        columns.append(np.cumsum(c, dtype=np.uint64) if k == 0 else c)
        at += 6 * n
    values = []
    for _ in range(n_values):
        values.append(np.ascontiguousarray(raw[at : at + 8 * n].reshape(8, n).T).view("<u8").reshape(n).astype(np.int64))
        at += 8 * n
    return columns, values


BLOCK = "kind string, bucket int, n long, block binary"


def _blocks(kind: str, key: np.ndarray, columns: list[np.ndarray], values: list[np.ndarray], buckets: int) -> Iterator[tuple]:
    """Packed rows per bucket: a bucket is a range of ``key``."""
    if not len(key):
        return
    bucket = (key * np.uint64(buckets) >> np.uint64(HASH_BITS)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in range(buckets):
        rows = order[cuts[b] : cuts[b + 1]]
        if len(rows):
            yield kind, b, len(rows), pack([c[rows] for c in columns], [v[rows] for v in values])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["kind", "bucket", "n", "block"])


def _merged(tables: Iterator[pa.RecordBatch] | pa.Table, n_columns: int, n_values: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """All blocks of a bucket as one set of sorted rows; blocks are folded in as they come."""
    columns, values = [np.zeros(0, np.uint64)] * n_columns, [np.zeros(0, np.int64)] * n_values
    held, size = [(columns, values)], 0
    for n, block in zip(tables.column("n").to_pylist(), tables.column("block")):
        held.append(unpack(block.as_py(), n, n_columns, n_values))
        size += n
        if size > 2 * BUCKET_GRAMS:
            held, size = [sum_by_key([np.concatenate(c) for c in zip(*[h[0] for h in held])], [np.concatenate(v) for v in zip(*[h[1] for h in held])])], 0
    return sum_by_key([np.concatenate(c) for c in zip(*[h[0] for h in held])], [np.concatenate(v) for v in zip(*[h[1] for h in held])])


class Model:
    """A stored model's place and totals; small, and sent to tasks as it is."""

    def __init__(self, folder: str, order: int, files: dict[str, list[tuple[int, str, int]]], discounts: dict[int, list[float]], totals: dict[str, int]):
        self.folder, self.order, self.files, self.discounts, self.totals = folder, order, files, discounts, totals

    def describe(self) -> str:
        return json.dumps({"order": self.order, "discounts": self.discounts, "totals": self.totals})


def _write_arrays(folder: str, stem: str, keys: np.ndarray, values: list[np.ndarray]) -> str:
    """One file: the width of each array of values (a byte each, eight in all), the keys, and the arrays in the least width that they fit."""
    widths = [next(w for w in (1, 2, 4, 8) if int(v.max(initial=0)) < 1 << 8 * w) for v in values]
    store, root = open_folder(folder)
    store.create_dir(root, recursive=True)
    path = attempt_name(root, stem, ".arrays")
    with store.open_output_stream(path, compression=None) as out:
        out.write(bytes(widths).ljust(8, b"\0"))
        for a in (keys.astype("<u8"), *[v.astype(f"<u{w}") for v, w in zip(values, widths)]):
            out.write(a.tobytes())
    return path


def train(docs: DataFrame, learn: Column, order: int = 2, buckets: int | None = None) -> Model:
    """Count the texts of the rows of ``docs`` (doc_id, text) where ``learn`` holds, and store the model.

    A null text is the empty one (its end is counted); repeated rows count each. Without any row the
    model is uniform over the unknown word. All counts are over all learned rows.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "kneser-ney")
    texts = docs.filter(learn).select(F.col("text").cast("string"))
    if buckets is None:
        n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = int(max(4, min(1 << 16, -(-n_bytes // (5 * BUCKET_GRAMS)))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held, size = [], 0

        def report() -> Iterator[pa.RecordBatch]:
            words = np.concatenate(held)
            (unique,), (times,) = sum_by_key([words], [np.ones(len(words), np.int64)])
            for row in _blocks("words", unique, [unique], [times], buckets):
                yield _batch([row])
            if order > 1:
                grams = padded(held, order)
                columns, (times,) = sum_by_key(list(grams.T), [np.ones(len(grams), np.int64)])
                key = gram_hash(np.stack(columns, axis=1))
                for row in _blocks(f"grams{order}", key, columns, [times], buckets):
                    yield _batch([row])

        for b in batches:
            for text in b.column("text"):
                held.append(text_words(text.as_py(), hashes))
                size += len(held[-1])
                if size >= GATHER_WORDS:
                    yield from report()
                    held, size = [], 0
        if held:
            yield from report()

    stats: list = []
    discounts: dict[int, list[float]] = {}
    rows, before = texts.mapInArrow(count, BLOCK), None
    for k in range(order, 0, -1):
        made = materialize(rows.groupBy("kind", "bucket").applyInArrow(_order_step(folder, k, order, buckets), f"{BLOCK}, path string, s array<long>"), f"kneser-ney-{k}")
        if before is not None:
            drop_scratch(before)
        before = made
        stats += made.filter("path IS NOT NULL").select("kind", "bucket", "n", "path", "s").collect()  # a row a bucket and kind
        found = np.sum([r["s"] for r in stats if r["kind"] == f"grams{k}"], axis=0) if any(r["kind"] == f"grams{k}" for r in stats) else np.zeros(5, np.int64)
        n1, n2, n3, n4 = (int(x) for x in found[1:5])
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
        # where counts of counts are missing a discount keeps to its bounds
        discounts[k] = [min(max(j - (j + 1) * y * (b / a if a else 0.0), 0.0), float(j)) for j, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        rows = made.filter("path IS NULL").select("kind", "bucket", "n", "block")
    drop_scratch(before)
    files: dict[str, list] = {}
    low = np.sum([r["s"] for r in stats if r["kind"] == "grams1"], axis=0) if any(r["kind"] == "grams1" for r in stats) else np.zeros(5, np.int64)
    n_low = sum(r["n"] for r in stats if r["kind"] == "grams1")
    totals: dict[str, int] = {"buckets": buckets, "grams1.n1": int(low[1]), "grams1.n2": int(low[2]), "grams1.n3": int(n_low - low[1] - low[2])}
    for r in sorted(stats, key=lambda r: (r["kind"], r["bucket"])):
        files.setdefault(r["kind"], []).append((r["bucket"], r["path"], r["n"]))
        for name, value in (("rows", r["n"]), ("sum", r["s"][0])):
            totals[f"{r['kind']}.{name}"] = totals.get(f"{r['kind']}.{name}", 0) + value
    return Model(folder, order, files, discounts, totals)


def _order_step(folder: str, k: int, order: int, buckets: int):
    """Merges and stores one bucket of an order's n-grams, of the words, or of the contexts that the order above passed on."""
    schema = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("n", pa.int64()), ("block", pa.binary()), ("path", pa.string()), ("s", pa.list_(pa.int64()))])

    def step(keys: tuple, table: pa.Table) -> pa.Table:
        kind, bucket = keys[0].as_py(), keys[1].as_py()
        if kind == f"contexts{k + 1}":
            (key,), sums = _merged(table, 1, 4)
            rows = [(kind, bucket, len(key), None, _write_arrays(folder, f"{kind}-{bucket:06d}", key, sums), [int(sums[0].sum())])]
            return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
        columns, (counts,) = _merged(table, 1 if kind == "words" else k, 1)
        grams = np.stack(columns, axis=1)
        key = gram_hash(grams)
        by_key = np.argsort(key, kind="stable")
        path = _write_arrays(folder, f"{kind}-{bucket:06d}", key[by_key], [counts[by_key]])
        s = [int(counts.sum()), *[int((counts == j).sum()) for j in (1, 2, 3, 4)]]
        rows = [(kind, bucket, len(key), None, path, s)]
        if kind == "words":
            if order == 1:  # the words are the n-grams of order 1
                extra = _write_arrays(folder, f"grams1-{bucket:06d}", key[by_key], [counts[by_key]])
                rows.append(("grams1", bucket, len(key), None, extra, s))
        elif k > 1:
            ends, (times,) = sum_by_key(columns[1:], [np.ones(len(counts), np.int64)])
            rows += [(*r, None, None) for r in _blocks(f"grams{k - 1}", gram_hash(np.stack(ends, axis=1)), ends, [times], buckets)]
            context = gram_hash(grams[:, :-1])
            kept, sums = sum_by_key([context], [counts, *[(counts == j).astype(np.int64) for j in (1, 2)], (counts >= 3).astype(np.int64)])
            rows += [(*r, None, None) for r in _blocks(f"contexts{k}", kept[0], kept, sums, buckets)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return step


class MappedArrays:
    """The sorted hash arrays of one kind, mapped into memory bucket by bucket as they are asked for."""

    def __init__(self, folder: str, files: list[tuple[int, str, int]], n_values: int, buckets: int):
        self.files = {b: (path, n) for b, path, n in files}
        self.store, _ = open_folder(folder)
        self.n_values, self.buckets = n_values, buckets
        self.open: OrderedDict[int, tuple[np.ndarray, list[np.ndarray]]] = OrderedDict()

    def _bucket(self, b: int) -> tuple[np.ndarray, list[np.ndarray]] | None:
        if b not in self.files:
            return None
        if b not in self.open:
            path, n = self.files[b]
            if isinstance(self.store, fs.LocalFileSystem):
                raw = np.memmap(path, np.uint8, "r")
            else:  # a store that can't be mapped: the bucket is read, and few are kept
                with self.store.open_input_stream(path, compression=None) as source:
                    raw = np.frombuffer(source.read(), np.uint8)
            widths = [int(w) for w in raw[: self.n_values]]
            at = np.cumsum([8 + 8 * n, *[w * n for w in widths]]).tolist()
            self.open[b] = raw[8 : at[0]].view("<u8"), [raw[a:z].view(f"<u{w}") for a, z, w in zip(at, at[1:], widths)]
            if len(self.open) > (4096 if isinstance(self.store, fs.LocalFileSystem) else 8):
                self.open.popitem(last=False)
        return self.open[b]

    def get(self, keys: np.ndarray) -> list[np.ndarray]:
        """The values of each key, 0 where it is not stored; every distinct key is looked up once, in order."""
        unique, inverse = np.unique(keys, return_inverse=True)
        out = [np.zeros(len(unique), np.int64) for _ in range(self.n_values)]
        bucket = (unique * np.uint64(self.buckets) >> np.uint64(HASH_BITS)).astype(np.int64)
        cuts = np.searchsorted(bucket, np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            stored = self._bucket(b)
            if stored is None:
                continue
            part = unique[cuts[b] : cuts[b + 1]]
            at = np.minimum(np.searchsorted(stored[0], part), len(stored[0]) - 1)
            hit = np.flatnonzero(stored[0][at] == part)
            for o, v in zip(out, stored[1]):
                o[cuts[b] + hit] = v[at[hit]]
        return [o[inverse] for o in out]


class Scorer:
    """Looks up and scores batches of texts with a stored model."""

    def __init__(self, model: Model, buckets: int):
        self.model, self.order = model, model.order
        kinds = {**{f"grams{k}": 1 for k in range(1, self.order + 1)}, **{f"contexts{k}": 4 for k in range(2, self.order + 1)}, "words": 1}
        self.arrays = {k: MappedArrays(model.folder, model.files.get(k, []), n, buckets) for k, n in kinds.items()}
        self.train_tokens = model.totals.get("words.sum", 0)
        self.vocabulary = model.totals.get("words.rows", 0)

    def discount(self, k: int, counts: np.ndarray) -> np.ndarray:
        return np.asarray([0.0, *self.model.discounts[k]])[np.minimum(counts, 3)]

    def probabilities(self, grams: np.ndarray) -> np.ndarray:
        """p(last word of each row | the words before)."""
        # order 1 has one context, the empty one
        ones = self.arrays["grams1"].get(gram_hash(grams[:, -1:]))[0]
        total, (n1, n2, n3) = self.model.totals.get("grams1.sum", 0), self._unigram_follow()
        uniform = 1.0 / (self.vocabulary + 1)
        d = self.model.discounts[1]
        if total:
            rest = (d[0] * n1 + d[1] * n2 + d[2] * n3) / total
            p = np.maximum(ones - self.discount(1, ones), 0.0) / total + rest * uniform
        else:
            p = np.full(len(grams), uniform)
        for k in range(2, self.order + 1):
            counts = self.arrays[f"grams{k}"].get(gram_hash(grams[:, -k:]))[0]
            total, n1, n2, n3 = self.arrays[f"contexts{k}"].get(gram_hash(grams[:, -k:-1]))
            d = self.model.discounts[k]
            seen = total > 0
            safe = np.maximum(total, 1)
            higher = np.maximum(counts - self.discount(k, counts), 0.0) / safe
            rest = (d[0] * n1 + d[1] * n2 + d[2] * n3) / safe
            p = np.where(seen, higher + rest * p, p)
        return p

    def _unigram_follow(self) -> tuple[int, int, int]:
        t = self.model.totals
        return t["grams1.n1"], t["grams1.n2"], t["grams1.n3"]

    def score(self, arrays: list[np.ndarray]) -> list[tuple[int, int, float, float]]:
        """Of each text: tokens, tokens known from training, log10 of the base's and the model's probability."""
        sizes = np.asarray([len(a) for a in arrays])
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        words = np.concatenate(arrays)
        counts = self.arrays["words"].get(words)[0]
        base = np.log10((counts + 0.5) / (self.train_tokens + 0.5 * (self.vocabulary + 1)))
        model = np.log10(self.probabilities(padded(arrays, self.order)))
        known = np.add.reduceat((counts > 0).astype(np.int64), first)
        return list(zip(sizes.tolist(), known.tolist(), np.add.reduceat(base, first).tolist(), np.add.reduceat(model, first).tolist()))


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text) with n_tokens, n_known, train_tokens, base_score, score and perplexity of each whole text.

    A null or empty text has one token, its end. Longer texts than BATCH_WORDS are scored whole.
    Repeated rows are scored each, an empty table gives no rows, and columns of these names are replaced.
    """
    made = {"n_tokens": "long", "n_known": "long", "train_tokens": "long", "base_score": "double", "score": "double", "perplexity": "double"}
    docs = docs.drop(*made)
    buckets = model.totals["buckets"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, scorer = WordHashes(), Scorer(model, buckets)
        for b in batches:
            texts, at = b.column("text").to_pylist(), 0
            while at < len(texts):
                held, size, first = [], 0, at
                while at < len(texts) and size < BATCH_WORDS:
                    held.append(text_words(texts[at], hashes))
                    size += len(held[-1])
                    at += 1
                rows = [(n, k, scorer.train_tokens, base, value, 10.0 ** (-value / n)) for n, k, base, value in scorer.score(held)]
                kinds = [pa.int64() if t == "long" else pa.float64() for t in made.values()]
                yield pa.record_batch([*b.slice(first, at - first).columns, *[pa.array(c, t) for c, t in zip(zip(*rows), kinds)]], names=[*b.schema.names, *made])

    schema = StructType(list(docs.schema.fields))
    for name, kind in made.items():
        schema = schema.add(name, kind)
    return docs.mapInArrow(score, schema)
