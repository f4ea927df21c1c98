"""Vector and perceptual-hash functions."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, LongType, StringType

from catalens.functions.binding import once


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def vec_normalize(v: Column) -> Column:
    """v divided by its length; a zero vector stays."""
    return F.when(norm(v) > 0, F.transform(v, lambda x: x.cast("double") / norm(v))).otherwise(F.transform(v, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """The dot product of vectors of length one, rounded so that equal scores tie on every engine."""
    return F.round(dot(a, b), 6)


def sign_hash(v: Column) -> Column:
    """64 bits, one for each of the first 64 values: whether it is over the vector's median."""
    values = F.slice(v.cast("array<double>"), 1, 64)
    middle = lambda ordered: (F.get(ordered, F.lit(31)) + F.get(ordered, F.lit(32))) / 2
    median = once(F.sort_array(values), middle)
    bits = once(median, lambda m: F.array_join(F.transform(values, lambda x: F.when(x > m, "1").otherwise("0")), ""))
    return F.conv(bits, 2, -10).cast("long")


def phash_score(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.bit_count(a.bitwiseXOR(b)) / 64)


@F.pandas_udf(StringType())
def vec_encode(v: pd.Series) -> pd.Series:
    """Base64 of the little-endian 32-bit floats."""
    flat = np.concatenate([np.asarray(x, "<f4") for x in v if x is not None] or [np.empty(0, "<f4")]).tobytes()  # a batch at once
    ends = np.cumsum([0 if x is None else 4 * len(x) for x in v]).tolist()
    return pd.Series([None if x is None else base64.b64encode(flat[end - 4 * len(x) : end]).decode() for x, end in zip(v, ends)], dtype=object)


def vec_decode(dim: int):
    """The inverse of vec_encode(); null for what is no base64 of ``dim`` floats."""

    @F.pandas_udf(ArrayType(FloatType()))
    def decode(text: pd.Series) -> pd.Series:
        def one(t):
            try:
                raw = base64.b64decode(t, validate=True)
            except (TypeError, ValueError):
                return None
            return np.frombuffer(raw, "<f4") if len(raw) == 4 * dim else None

        return text.map(one)

    return decode


def _grid(values) -> np.ndarray:
    """A flat list of points as the largest square picture that it fills."""
    side = int(len(values) ** 0.5)
    return np.asarray(values[: side * side], np.float64).reshape(side, side)


def _resized(picture: np.ndarray, size: int) -> np.ndarray:
    """Linear interpolation of a square picture to ``size`` points a side."""
    at = np.linspace(0, len(picture) - 1, size)
    low = np.minimum(at.astype(int), max(0, len(picture) - 2))
    high, part = np.minimum(low + 1, len(picture) - 1), at - low
    rows = picture[low] * (1 - part)[:, None] + picture[high] * part[:, None]
    return rows[:, low] * (1 - part) + rows[:, high] * part


@F.pandas_udf(LongType())
def phash_pixels(points: pd.Series) -> pd.Series:
    """64 bits of a picture: its 8 by 8 lowest cosine frequencies at 32 points a side, each over their median or not."""
    k, n = np.arange(8)[:, None], np.arange(32)[None, :]
    waves = np.cos(np.pi * k * (2 * n + 1) / 64)

    def one(v):
        if v is None or len(v) == 0:
            return None
        low = waves @ _resized(_grid(v), 32) @ waves.T
        bits = (low > np.median(low)).reshape(-1)
        return int(np.packbits(bits).view(">i8")[0])

    return points.map(one)


# Fixed values of the picture model's input: mean and deviation of red, green and blue.
CLIP_MEAN = (0.48145466, 0.4578275, 0.40821073)
CLIP_STD = (0.26862954, 0.26130258, 0.27577711)

#: Bits after the point of a weight.
WEIGHT_BITS = 22


@lru_cache(64)
def cubic_weights(n_in: int, n_out: int) -> np.ndarray:
    """A row of weights of the old points for each new one: bicubic with a = -0.5, wider where points become fewer.

    Weights are whole numbers of WEIGHT_BITS bits after the point, so that halves round alike everywhere.
    """
    scale = n_in / n_out
    x = np.abs(np.arange(n_in)[None, :] + 0.5 - (np.arange(n_out)[:, None] + 0.5) * scale) / max(scale, 1.0)
    w = np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0))
    return np.floor(w / w.sum(axis=1, keepdims=True) * (1 << WEIGHT_BITS) + 0.5).astype(np.int64)


def _clip(size: int):
    """The function of one picture that clip_tensor() and clip_tensors() apply."""
    #: What each 8-bit value becomes in each plane.
    levels = ((np.arange(256)[:, None] / 255.0 - CLIP_MEAN) / CLIP_STD).astype(np.float32)

    def resized(planes: np.ndarray, n_out: int, at: int) -> np.ndarray:
        """``planes`` at ``n_out`` points along their last side, of which ``size`` are kept from ``at``; whole numbers, so sums are exact."""
        n_in = planes.shape[-1]
        if n_out == n_in:
            return planes[..., at : at + size]
        sums = planes.astype(np.float64) @ cubic_weights(n_in, n_out)[at : at + size].T
        return np.clip(np.floor((sums + (1 << WEIGHT_BITS - 1)) / (1 << WEIGHT_BITS)), 0, 255).astype(np.uint8)

    def one(raw, w, h):
        if raw is None or w is None or h is None or not w > 0 or not h > 0 or len(raw) != int(w) * int(h) * 3:  # also for NaN
            return None
        w, h = int(w), int(h)
        planes = np.frombuffer(raw, np.uint8).reshape(h, w, 3).transpose(2, 0, 1)
        wide, high = (max(size, round(n * size / min(w, h))) for n in (w, h))
        planes = resized(planes, wide, (wide - size) // 2).transpose(0, 2, 1)
        planes = resized(planes, high, (high - size) // 2).transpose(0, 2, 1)
        return np.stack([levels[:, c][planes[c]] for c in range(3)]).reshape(-1)

    return one


def clip_tensor(size: int = 224):
    """The picture model's input from (pixels, width, height), pixels being rows of 8-bit red, green and blue.

    The short side becomes ``size`` by bicubic interpolation (rows first, 8 bits after each pass), the
    middle ``size`` by ``size`` points are kept, brought to 0..1 and standardised; the result is a
    list of three planes. Null for a null picture and where the bytes are not width x height x 3.
    """

    one = _clip(size)

    @F.pandas_udf(ArrayType(FloatType()))
    def tensor(pixels: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        return pd.Series([one(*x) for x in zip(pixels, width, height)], dtype=object)

    return tensor


#: Pictures whose tensors a task holds at once, and how many numbers these are at most.
CLIP_ROWS, CLIP_NUMBERS = 256, 1 << 22


def clip_tensors(rows: DataFrame, size: int = 224) -> DataFrame:
    """(id, tensor) of rows (id, pixels, width, height): as clip_tensor(), with CLIP_ROWS tensors at once (of a large ``size`` as many as have CLIP_NUMBERS numbers) instead of a whole batch's."""
    one = _clip(size)
    step = max(1, min(CLIP_ROWS, CLIP_NUMBERS // (3 * size * size)))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                tensors = [one(*x) for x in zip(*(part.column(c).to_pylist() for c in ("pixels", "width", "height")))]
                ends = np.cumsum([0, *(0 if t is None else len(t) for t in tensors)]).astype(np.int32)
                numbers = np.concatenate([t for t in tensors if t is not None] or [np.empty(0, np.float32)])
                missing = pa.array([t is None for t in tensors])
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(numbers), mask=missing)
                yield pa.RecordBatch.from_arrays([part.column("id"), listed], ["id", "tensor"])

    return rows.select(F.col("id").cast("long").alias("id"), "pixels", "width", "height").mapInArrow(made, "id long, tensor array<float>")
