"""Hard-negative mining with the threshold algorithm over sorted lists.

A task takes its rows in blocks and sorts them once in every dimension. For an anchor it reads all
lists from the end that the anchor's sign favours (sorted access), scores each row that it meets for
the first time (random access) and stops as soon as no unmet row can matter: the sum over dimensions of
anchor times list value at the depth reached bounds every unmet row, and once it is strictly below
the k-th score that each window has so far, no unmet row can enter, not even by a tie. Every block
gives its best k of a window, and only those are shuffled to be merged.

The anchors lie as Parquet files of bounded size in the shared folder, and tasks read one file at a
time, so neither the driver nor a task ever holds them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalens.llm._blobs import open_folder
from catalens.llm._common import materialize, scratch_path, scratch_scope

#: Rows of a block (its lists take about 12 bytes a row and dimension).
BLOCK_ROWS = 1 << 16
#: Anchors of a file.
FILE_ANCHORS = 4096
#: Depth of the first sorted accesses; it doubles with each step.
FIRST_DEPTH = 8
#: Sums of products under this are exact in doubles.
EXACT = 1 << 53


class Lists:
    """The rows of a block, sorted in every dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").T.astype(np.int32)  # per dimension, ascending
        self.values = np.take_along_axis(vectors.T, self.order, axis=1)
        self.largest = float(np.abs(vectors).max()) if vectors.size else 0.0

    def search(self, anchor: np.ndarray, windows: list[tuple[int | None, int | None]], k: int, wanted: np.ndarray) -> tuple[list[list[tuple[int, int]]], int]:
        """Per window (lowest and highest score, None: open) its first ``k`` (score, id) of the ``wanted`` rows, and how many rows were scored."""
        n = len(self.ids)
        anchor, vectors = self._alike(anchor)
        exact = anchor.dtype != object
        used = np.flatnonzero(anchor != 0)
        rising = anchor[used] < 0  # where the smallest values score best
        met = ~wanted
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, anchor.dtype), np.empty(0, np.int64)) for _ in windows]
        depth, step, scored = 0, FIRST_DEPTH, 0
        while True:
            last = min(n, depth + step)
            fresh = ~met
            if len(used) and last < n:
                seen = np.zeros(n, bool)
                seen[self.order[used[rising], depth:last]] = True
                seen[self.order[used[~rising], n - last : n - depth]] = True
                fresh &= seen
            rows = np.flatnonzero(fresh)
            if len(rows):
                met[rows] = True
                scored += len(rows)
                scores, ids = vectors[rows] @ anchor, self.ids[rows]
                for i, (low, high) in enumerate(windows):
                    fits = np.ones(len(rows), bool) if low is None else scores >= low
                    if high is not None:
                        fits &= scores <= high
                    if fits.any():
                        s, d = np.concatenate([best[i][0], scores[fits]]), np.concatenate([best[i][1], ids[fits]])
                        first = np.lexsort((d, -s))[:k] if exact else sorted(range(len(s)), key=lambda j: (-s[j], d[j]))[:k]
                        best[i] = (s[first], d[first])
            if last == n or met.all():
                break
            ends = np.where(rising, self.values[used, last - 1], self.values[used, n - last])
            bound = ends.astype(anchor.dtype) @ anchor[used]
            # a window is closed when no unmet row can enter it: below its k-th score, or below its lower end
            if all(bound < b[0][k - 1] if len(b[0]) == k else low is not None and bound < low for b, (low, _) in zip(best, windows)):
                break
            depth, step = last, 2 * step
        return [[(int(s), int(d)) for s, d in zip(*b)] for b in best], scored

    def _alike(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The anchor and the vectors with as many dimensions as the longer has, in a type in which scores are exact."""
        vectors = self.vectors
        most = max(len(anchor), vectors.shape[1])
        if len(anchor) < most:
            anchor = np.pad(anchor, (0, most - len(anchor)))
        elif vectors.shape[1] < most:  # further dimensions are zeros in this block
            vectors = np.pad(vectors, ((0, 0), (0, most - vectors.shape[1])))
            extra = np.zeros((most - self.values.shape[0], len(self.ids)))
            self.values = np.concatenate([self.values, extra])
            self.order = np.concatenate([self.order, np.tile(np.arange(len(self.ids), dtype=np.int32), (len(extra), 1))])
            self.vectors = vectors
        if self.largest * float(np.abs(anchor).max(initial=0.0)) * max(1, most) < EXACT:
            return anchor, vectors
        whole = np.vectorize(int, otypes=[object])
        return whole(anchor), whole(vectors) if vectors.size else vectors.astype(object)


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(ids, labels, vectors) of up to ``rows`` rows, equal rows once."""
    held: dict[tuple, np.ndarray] = {}
    for batch in batches:
        column = batch.column("v")
        flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        for i, (vec_id, label) in enumerate(zip(batch.column("vec_id").to_pylist(), batch.column("label").to_pylist())):
            vector = flat[ends[i] - ends[0] : ends[i + 1] - ends[0]]
            held[(vec_id, label, vector.tobytes())] = vector
            if len(held) >= rows:
                yield np.array([h[0] for h in held]), np.array([h[1] for h in held]), list(held.values())
                held = {}
    if held:
        yield np.array([h[0] for h in held]), np.array([h[1] for h in held]), list(held.values())


def _lists(ids: np.ndarray, labels: np.ndarray, vectors: list[np.ndarray]) -> Lists:
    matrix = np.zeros((len(vectors), max(map(len, vectors))))
    for i, v in enumerate(vectors):
        matrix[i, : len(v)] = v
    return Lists(ids, labels, matrix)


def _anchor_files(anchors: DataFrame, label: str) -> str:
    """Write ``anchors`` in files of up to FILE_ANCHORS rows and return their folder."""
    path = scratch_path(anchors.sparkSession, label)
    anchors.write.option("maxRecordsPerFile", FILE_ANCHORS).parquet(path)
    return path


def _read_anchors(folder: str) -> Iterator[dict]:
    """The rows of the folder's files, one file at a time."""
    from pyarrow import fs

    store, path = open_folder(folder)
    files = sorted(f.path for f in store.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet"))
    for name in files:
        with store.open_input_file(name) as f:
            yield from pq.ParquetFile(f).read().to_pylist()


def _search(rows: DataFrame, folder: str, k: int, same: bool, block_rows: int) -> DataFrame:
    """(anchor_id, window, other_id, score) of each block's best ``k`` in every window of the anchors in ``folder``.

    ``same`` takes rows of the anchor's label, without the anchor, else those of other labels.
    """
    bound = (1 << 63) - 1

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, vectors in _blocks(batches, block_rows):
            groups = {}
            if same:  # a label's rows have lists of their own
                places = np.argsort(labels, kind="stable")
                ends = np.flatnonzero(np.diff(labels[places])) + 1
                groups = {labels[p[0]]: _lists(ids[p], labels[p], [vectors[i] for i in p]) for p in np.split(places, ends)}
            else:
                groups = {None: _lists(ids, labels, vectors)}
            # rows of one id with several vectors count with the best of them: look k times as far
            depth = {g: k * int(np.unique(x.ids, return_counts=True)[1].max()) for g, x in groups.items()}
            out: list[tuple[int, int, int, int]] = []
            for a in _read_anchors(folder):
                group = a["label"] if same else None
                lists = groups.get(group)
                if lists is None:
                    continue
                wanted = lists.ids != a["vec_id"] if same else lists.labels != a["label"]
                windows = a.get("windows") or [{"low": None, "high": None}]
                found, _ = lists.search(np.array(a["v"]), [(w["low"], w["high"]) for w in windows], depth[group], wanted)
                out.extend((a["vec_id"], i, d, max(-bound, min(bound, s))) for i, f in enumerate(found) for s, d in f)
                if len(out) >= 1 << 16:
                    yield _table(out)
                    out = []
            if out:
                yield _table(out)

    return rows.select("vec_id", "label", "v").mapInArrow(find, "anchor_id long, window int, other_id long, score long")


def _table(out: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["anchor_id", "window", "other_id", "score"])


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first ``k`` (rank, other_id, score) of each key; an id counts once, with its best score."""
    best = found.groupBy(*keys, "other_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "other_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def whole_vectors(vectors: DataFrame, scale: int = 256, label: Column | None = None) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, v in whole numbers: floor(scale * x).

    Rows with a null vec_id, label or vector, or a component that is null or, scaled, not finite, take no part.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) != float("inf"))
    x = F.col("embedding").cast("array<double>")
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall(x, lambda c: F.coalesce(finite(c), F.lit(False))), F.lit(False))
    rows = vectors.filter(usable)
    # doubles beyond EXACT are whole numbers already
    whole = F.transform(x, lambda c: F.when(F.abs(c * scale) < EXACT, F.floor(c * scale).cast("double")).otherwise(c * scale))
    return rows.select(F.col("vec_id").cast("long"), (F.col("label") if label is None else label).cast("long").alias("label"), whole.alias("v"))


def hard_negatives(rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 5, low_percent: int = 80, high_percent: int = 100, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Of every anchor and each of its positives the hardest negatives among all ``rows`` (vec_id, label, v: see whole_vectors).

    An anchor's positives are its first ``n_positives`` other rows of its label by integer inner
    product (ties: smaller vec_id). A pair's negatives are the first ``n_negatives`` rows of other
    labels whose score is ``low_percent`` to ``high_percent`` percent of the positive's: none where the
    positive's score is negative. Returns anchor_id, positive_id, rank (from 1), negative_id,
    positive_score and negative_score.

    Rows of one vec_id are one candidate with the best of their scores, and never positives of it;
    repeated anchors count once (of different ones that with the smallest label and vector). Shorter
    vectors count as ended by zeros. Scores are exact; beyond 64 bits they are returned as the nearest 64-bit
    number. Other columns are ignored; an empty table, or one without anchors, gives no rows.
    """
    with scratch_scope(rows.sparkSession) as keep:
        anchors = rows.filter(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v")
        anchors = materialize(anchors, "negatives-anchors")
        found = _search(rows, _anchor_files(anchors, "negatives-queries"), n_positives, True, block_rows)
        found = _first(found, ["anchor_id"], n_positives).select("anchor_id", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
        # windows in whole numbers: the smallest and the largest score that satisfy both conditions
        score = F.col("positive_score").cast("decimal(28,0)")
        low, high = F.ceil(score * low_percent / 100).cast("long"), F.floor(score * high_percent / 100).cast("long")
        positives = materialize(found.withColumns({"low": low, "high": high}).filter("low <= high"), "negatives-positives")
        windows = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_set(F.struct("low", "high"))).alias("windows"))  # n_positives at most
        queries = materialize(anchors.join(windows, "vec_id"), "negatives-windows")
        found = _first(_search(rows, _anchor_files(queries, "negatives-queries"), n_negatives, False, block_rows), ["anchor_id", "window"], n_negatives)
        by_window = queries.select(F.col("vec_id").alias("anchor_id"), F.posexplode("windows").alias("window", "w")).select("anchor_id", "window", "w.low", "w.high")
        pairs = positives.join(by_window, ["anchor_id", "low", "high"]).join(found, ["anchor_id", "window"])
        return keep(pairs.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")


def hard_negatives_sql() -> str:
    """hard_negatives() with its query's parameters over the table embeddings, as SQL."""
    return """WITH usable AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v
        FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    anchors AS (SELECT * FROM usable WHERE vec_id % 100 = 0),
    scored AS (SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * r.v[i])) AS BIGINT) AS score FROM anchors a JOIN usable r ON a.vec_id <> r.vec_id),
    positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS nth FROM scored WHERE same) WHERE nth <= 5),
    negatives AS (SELECT p.*, n.other_id AS negative_id, n.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) AS nth
        FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * positive_score <= 100 * n.score AND n.score <= positive_score)
    SELECT anchor_id, positive_id, CAST(nth AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negatives WHERE nth <= 5"""
