"""Sharding by a k-d tree over document metadata (DataFrame operations only).

The items of the tree are groups of equal texts, so copies travel together. Only a group that
alone exceeds a shard is divided, by a hash of its ids, into pieces of ``heavy_share`` of a
shard; fewer than ``n_shards`` groups are as large, which bounds what is broadcast. Every node is
split along its widest dimension at the byte-weighted median (for an odd number of shards, at the
weighted quantile that leaves whole shards on both sides) until each leaf is one shard. Items
over ``heavy_share`` of a shard take the side where the median puts them; then the cut of the
lighter ones is found anew, so that they even out what a heavy item left over or under.
The median is found from histograms that Spark aggregates for all nodes of a level at once;
the driver sees at most ``n_shards * BINS`` histogram rows, whatever the input.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalens.llm._common import drop_scratch, materialize

#: Histogram bins of a node in one pass; a pass narrows the search by this factor.
BINS = 512
#: Bits of a coordinate and of the tie-breaking hash in a split key.
COORD_BITS, TIE_BITS = 30, 32
#: Bytes that a row is counted for beside its text.
ROW_OVERHEAD = 16


def lexical_coordinate(text: Column) -> Column:
    """The place of a string in byte order, from its first six bytes; null comes first."""
    head = F.rpad(F.substring(F.hex(F.coalesce(text, F.lit("")).cast("binary")), 1, 12), 12, "0")
    return F.conv(head, 16, 10).cast("double")


def _of(level: int, values: dict[int, int], node: Column | None = None) -> Column:
    """The value of a row's node, from one literal array over the nodes of a level; null elsewhere."""
    base = 1 << level  # heap numbering: the level holds nodes base to 2 * base - 1
    return F.get(F.array(*[F.lit(values.get(base + i)).cast("long") for i in range(base)]), (F.col("__node") if node is None else node) - base)


def _cuts(keyed: DataFrame, level: int, bounds: dict[int, tuple[int, int]], want: dict[int, float], tolerance: float) -> dict[int, int]:
    """Per node, the key below which ``want`` of its weight lies, to ``tolerance`` or one key."""
    lo, hi, below, cut = ({k: b[0] for k, b in bounds.items()}, {k: b[1] for k, b in bounds.items()}, dict.fromkeys(bounds, 0), {})
    while lo:
        width = {k: -(-(hi[k] - lo[k] + 1) // BINS) for k in lo}
        at = keyed.select("__node", "__w", (F.col("__key") - _of(level, lo)).alias("__at"), (_of(level, {k: hi[k] - lo[k] for k in lo})).alias("__last"), _of(level, width).alias("__width"))
        hist = at.filter(F.col("__at").between(F.lit(0), F.col("__last"))).groupBy("__node", F.expr("__at div __width").alias("__bin")).agg(F.sum("__w").alias("w"))
        bins: dict[int, list[tuple[int, int]]] = {}
        for r in hist.collect():  # at most BINS rows for each of at most n_leaves nodes
            bins.setdefault(r["__node"], []).append((r["__bin"], r["w"]))
        for k in list(lo):
            acc = below[k]
            for b, w in sorted(bins.get(k, [])):
                if acc + w >= want[k]:
                    first, under, over = lo[k] + b * width[k], want[k] - acc, acc + w - want[k]
                    last = min(first + width[k] - 1, hi[k])
                    if width[k] == 1 or min(under, over) <= tolerance:
                        cut[k] = first if under <= over else last + 1
                    else:
                        lo[k], hi[k], below[k] = first, last, acc
                    break
                acc += w
            else:
                cut[k] = hi[k] + 1
            if k in cut:
                del lo[k]
    return cut


def kd_leaves(items: DataFrame, dims: list[str], weight: str, tie: str, n_leaves: int, tolerance: float = 0.002, heavy_share: float = 0.02) -> DataFrame:
    """Add ``leaf`` (0 to ``n_leaves`` - 1) to ``items``.

    ``dims`` are double columns (null: smallest), ``weight`` a positive long, ``tie`` a long that
    orders equal coordinates. The weight left of a split differs from its share by at most
    ``tolerance`` of a leaf's target, or by half the weight of one key of items of at most
    ``heavy_share`` of that target; by more only where a node's heavier items leave no lighter
    ones to even them out. An empty table stays empty;
    items that are equal in every dimension are divided by ``tie``, and only equal ties stay together.
    """
    ends = [f(F.coalesce(d, F.lit(0.0))).alias(f"{n}{i}") for i, d in enumerate(dims) for n, f in (("lo", F.min), ("hi", F.max))]
    total = items.agg(F.sum(weight).alias("w"), *ends).first()
    if not total["w"]:
        return items.withColumn("leaf", F.lit(0))
    unit = items.withColumn("__node", F.lit(1).cast("long")).withColumn("leaf", F.lit(0))
    for i, d in enumerate(dims):  # whole numbers of COORD_BITS bits over the table's range
        span = (total[f"hi{i}"] - total[f"lo{i}"]) or 1.0
        unit = unit.withColumn(f"__q{i}", ((F.coalesce(d, F.lit(0.0)) - total[f"lo{i}"]) / span * ((1 << COORD_BITS) - 1)).cast("long"))
    axes = range(len(dims))
    heavy = heavy_share * total["w"] / n_leaves
    tie_low = F.col(tie).bitwiseAND(F.lit((1 << TIE_BITS) - 1))
    leaves, level, before = {1: (0, n_leaves)}, 0, None  # of each node its first shard and how many it holds
    while active := {k: n for k, (_, n) in leaves.items() if n > 1}:
        live = unit.filter(_of(level, active).isNotNull())
        ends = [f(f"__q{i}").alias(f"{n}{i}") for i in axes for n, f in (("lo", F.min), ("hi", F.max))]
        stats = {r["__node"]: r for r in live.groupBy("__node").agg(F.sum(weight).alias("w"), *ends).collect()}
        axis = {k: max(axes, key=lambda i: (r[f"hi{i}"] - r[f"lo{i}"], -i)) for k, r in stats.items()}
        bounds = {k: (r[f"lo{axis[k]}"] << TIE_BITS, ((r[f"hi{axis[k]}"] + 1) << TIE_BITS) - 1) for k, r in stats.items()}
        coordinate = F.get(F.array(*[F.col(f"__q{i}") for i in axes]), _of(level, axis).cast("int"))
        keyed = F.shiftleft(coordinate, TIE_BITS).bitwiseOR(tie_low)
        want = {k: r["w"] * (active[k] // 2) / active[k] for k, r in stats.items()}
        exact = tolerance * total["w"] / n_leaves
        seen = live.select("__node", F.col(weight).alias("__w"), keyed.alias("__key"))
        cut = _cuts(seen, level, bounds, want, exact)
        # where heavy items lie, the lighter ones are cut so that both together leave the share
        first = F.when(F.col("__key") < _of(level, cut), F.col("__w")).otherwise(0)
        sums = seen.filter(F.col("__w") > heavy).groupBy("__node").agg(F.sum(first).alias("left"))
        left = {r["__node"]: r["left"] for r in sums.collect()}  # one row a node
        light = dict(cut)
        if left:
            rest = {k: want[k] - left[k] for k in left}
            lighter = seen.filter((F.col("__w") <= heavy) & _of(level, left).isNotNull())
            light |= _cuts(lighter, level, {k: bounds[k] for k in left}, rest, exact)
        for k in active:
            start, n = leaves.pop(k)
            leaves[2 * k], leaves[2 * k + 1] = (start, n // 2), (start + n // 2, n - n // 2)
            if k not in stats:  # nothing lies here, so nothing is left to split
                leaves[2 * k], leaves[2 * k + 1] = (start, 1), (start, 1)
        child = 2 * F.col("__node") + F.when(keyed < F.when(F.col(weight) > heavy, _of(level, cut)).otherwise(_of(level, light)), 0).otherwise(1)
        unit = unit.withColumn("__node", F.when(_of(level, active).isNotNull(), child).otherwise(F.col("__node")))
        level += 1
        unit = unit.withColumn("leaf", F.coalesce(_of(level, {k: start for k, (start, _) in leaves.items()}).cast("int"), "leaf"))
        unit = materialize(unit, "kd-level")
        if before is not None:
            drop_scratch(before)
        before = unit
    return unit.drop("__node", *[f"__q{i}" for i in axes])


def kd_shards(docs: DataFrame, n_shards: int | None = 40, target_bytes: int | None = None, heavy_share: float = 0.02, slot_parts: int = 64) -> DataFrame:
    """Put every row of ``docs`` (doc_id, text, lang, source) into a shard of near-equal bytes.

    Give ``n_shards``, or ``target_bytes`` for shards of about that size. Returns doc_id, size
    (UTF-8 bytes + 16), text_crc32, shard, slot (0, 1, ... in each shard). A null text counts as
    none, a null id or label comes first in its dimension, repeated rows are rows of their own;
    other columns are ignored; an empty table gives no rows. Equal texts share a shard unless
    together they are larger than one. A single text longer than a shard makes that shard longer.
    """
    raw = F.coalesce("text", F.lit("")).cast("binary")
    rows = materialize(
        docs.select(
            "doc_id",
            (F.octet_length(raw) + ROW_OVERHEAD).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.xxhash64("text", F.md5(raw)).alias("group"),
            lexical_coordinate(F.col("lang")).alias("lang_at"),
            lexical_coordinate(F.col("source")).alias("source_at"),
        ),
        "kd-rows",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    if n_shards is None:
        n_shards = max(1, math.ceil(total / target_bytes))
    piece = max(1.0, total / n_shards * heavy_share)
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    large = groups.filter((F.col("n") > 1) & (F.col("bytes") > total / n_shards)).select("group", F.ceil(F.col("bytes") / piece).cast("long").alias("pieces"))
    rows = rows.join(F.broadcast(large), "group", "left")  # fewer than n_shards rows
    part = F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64("doc_id", "group"), F.col("pieces"))).otherwise(F.lit(0))
    rows = rows.withColumn("part", part).drop("pieces")
    items = rows.groupBy("group", "part").agg(
        F.sum("size").alias("bytes"),
        F.log2(F.max("size").cast("double")).alias("size_at"),
        F.min("lang_at").alias("lang_at"),
        F.min("source_at").alias("source_at"),
        F.min("doc_id").cast("double").alias("id_at"),
        F.xxhash64("group", "part").alias("tie"),
    )
    leaves = kd_leaves(materialize(items, "kd-items"), ["id_at", "size_at", "source_at", "lang_at"], "bytes", "tie", n_shards, heavy_share=heavy_share).select("group", "part", F.col("leaf").alias("shard"))
    placed = rows.join(leaves, ["group", "part"])
    # slots: a hash divides each shard into parts, whose sizes give every part its first slot
    placed = placed.select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slot_parts)).cast("int").alias("slice"))
    placed = materialize(placed, "kd-placed")
    counts = placed.groupBy("shard", "slice").count()
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "slice").orderBy("doc_id", "text_crc32")
    slot = (F.col("start") + F.row_number().over(within) - 1).cast("long")
    return placed.join(F.broadcast(starts), ["shard", "slice"]).select("doc_id", "size", "text_crc32", "shard", slot.alias("slot"))  # starts: n_shards * slot_parts rows
