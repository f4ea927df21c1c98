"""N-gram Jaccard join by prefixes under several global token orders.

A document is the set of its distinct word n-grams, as 64-bit hashes. Two sets x and y are similar
enough where they share at least a = ceil(t (|x| + |y|) / (1 + t)) tokens. Under every global order of
the tokens the first |x| - a + l tokens of x and the first |y| - a + l of y then share at least l.
Candidates come from one order: an equi-join on the tokens of the prefixes for l = 1, in which a token
counts only where it stands early enough on both sides for the sizes of the pair. For every order the
prefixes for l = COMMON are then intersected, and only pairs that pass all orders are verified on the
whole sets. As prefixes of long texts are long, pairs whose parity sketches differ in more bits than the
sets may in tokens are dropped before. Each order puts frequent tokens last. Which are frequent is counted on a sample of the
documents, on all their tokens; it changes the work, not the result. Order 0 sorts frequent tokens by
count, the others by the magnitude of the count and a seeded hash; all other tokens come in the order of
a seeded hash, so no corpus-wide sort of tokens is needed.

Equal sets are one class from the start. The result is the connected components of the links, so pairs
that are in one component already are not verified. Tokens of more than MAX_BUCKET classes first pair
every class with three pivots of the token; after the components of these links are known, the classes
outside the token's main component are paired with all others of the token. Nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.llm._common import materialize, scratch_scope
from catalens.llm._graph import connected_components
from catalens.llm._text import WordHashes, folded_words, mix

#: Seeds of the token orders: the first generates candidates, all filter them.
ORDERS = (0x51ED270B1F2E3D4C, 0x2545F4914F6CDD1D, 0x369DEA0F31A53F85)
#: Common prefix tokens that every order must show (fewer where the sets are as small).
COMMON = 4
#: One document in SAMPLE (by a hash of the text) is counted for the frequent tokens; those in at least
#: FREQUENT_LEAST of them are ranked, at most MAX_FREQUENT.
SAMPLE, FREQUENT_LEAST, MAX_FREQUENT = 8, 2, 1 << 18
#: Tokens that a task of Python counts at once, and tokens and sets that it holds to build rows.
COUNT_TOKENS, CHUNK_TOKENS, CHUNK_SETS = 1 << 19, 1 << 17, 512
MAX_BUCKET = 48
#: Bits of a set's parity sketch: at least two a token, a power of two within these bounds.
LEAST_SKETCH, MOST_SKETCH = 256, 1 << 15
#: Bits of the filter that tells which sets are needed for verification: so many for each, up to the bound.
BITS_PER_SET, MAX_FILTER_BITS, FILTER_HASHES = 16, 1 << 25, 4


def shingle_hashes(text: str | None, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; of fewer words the whole sequence; of none nothing."""
    words = folded_words(text)
    if not words:
        return np.zeros(0, np.int64)
    h = hashes.of(words)
    length = min(n, len(words))
    key = np.full(len(words) - length + 1, length, np.uint64)
    for k in range(length):
        key = mix(key ^ h[k : len(h) - length + 1 + k]) + np.uint64(k)
    return np.unique(key.view(np.int64))


def required(n: np.ndarray | int, percent: int):
    """The least overlap of a set of n with any set that is similar to ``percent`` %."""
    return (percent * n + 99) // 100


def _place(tokens: np.ndarray, order: int) -> np.ndarray:
    """The place of tokens in an order, frequency aside: 63 bits of a seeded hash."""
    return mix(tokens.view(np.uint64) ^ np.uint64(ORDERS[order])) >> np.uint64(1)


def frequent_tokens(texts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequent tokens of the sampled documents, sorted, with their ranks and magnitudes (log2) by count.

    All tokens of a sampled text count, once for all its copies in a task; counts are summed over the
    corpus before the threshold. The driver receives MAX_FREQUENT rows at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held, size, seen = [], 0, set()

        def report() -> pa.RecordBatch:
            tokens, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch([pa.array(tokens), pa.array(times.astype(np.int64))], names=["token", "times"])

        for b in batches:
            for text in b.column("text"):
                tokens = shingle_hashes(text.as_py(), n, hashes)
                key = set_id(tokens)
                if not len(tokens) or key in seen:  # copies tell nothing about tokens
                    continue
                seen.add(key)
                held.append(tokens)
                size += len(tokens)
                if size >= COUNT_TOKENS:
                    yield report()
                    held, size = [], 0
        if held:
            yield report()

    sample = texts.select(F.col("text").cast("string")).filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    found = sample.mapInArrow(count, "token long, times long").groupBy("token").agg(F.sum("times").cast("int").alias("times"))
    found = materialize(found.filter(F.col("times") >= FREQUENT_LEAST), "ngram-frequent")
    # the least count of which no more than MAX_FREQUENT tokens have as many
    least, kept = 1 << 31, 0
    for r in found.groupBy("times").count().orderBy(F.desc("times")).toLocalIterator():
        kept += r["count"]
        if kept > MAX_FREQUENT:
            break
        least = r["times"]
    rows = found.filter(F.col("times") >= least).toArrow()
    tokens, times = (rows.column(c).to_numpy() for c in ("token", "times"))
    order = np.argsort(tokens)
    tokens, times = tokens[order], times[order]
    ranks = np.zeros(len(tokens), np.uint64)
    ranks[np.lexsort((tokens, times))] = np.arange(len(tokens), dtype=np.uint64)
    return tokens, ranks, np.log2(np.maximum(times, 1)).astype(np.uint64)


class Prefixes:
    """The prefixes of one set under the orders."""

    def __init__(self, tokens: np.ndarray, frequent: tuple[np.ndarray, np.ndarray, np.ndarray], percent: int):
        self.tokens, self.least = tokens, int(required(len(tokens), percent))
        known, self.ranks, self.magnitude = frequent
        at = np.minimum(np.searchsorted(known, tokens), max(len(known) - 1, 0))
        self.late = np.flatnonzero(known[at] == tokens) if len(known) else np.zeros(0, np.int64)
        self.at = at[self.late]

    def first(self, order: int, common: int) -> np.ndarray:
        """The tokens that come first in an order, in that order, as many as show ``common`` of any similar set's."""
        place = _place(self.tokens, order)
        rank = self.ranks[self.at] if order == 0 else (self.magnitude[self.at] << np.uint64(56)) + (place[self.late] >> np.uint64(8))
        place[self.late] = np.uint64(1 << 63) + rank
        length = min(len(place), len(place) - self.least + common)
        if length < len(place):
            some = np.argpartition(place, length)[:length]
            return self.tokens[some[np.argsort(place[some], kind="stable")]]
        return self.tokens[np.argsort(place, kind="stable")]


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parities in 64-bit words: a bit tells whether an odd number of tokens falls to it."""
    bits = min(MOST_SKETCH, max(LEAST_SKETCH, 1 << (2 * len(tokens) - 1).bit_length()))
    odd = np.bincount((mix(tokens.view(np.uint64)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _lists(arrays: list[np.ndarray], kind: type = np.int64) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, kind), *arrays]).astype(kind)))


def _chunks(sets: Iterator[tuple[int, np.ndarray]]) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Numbered sets, gathered up to CHUNK_TOKENS tokens or CHUNK_SETS sets at a time."""
    held, size = [], 0
    for item in sets:
        held.append(item)
        size += len(item[1])
        if size >= CHUNK_TOKENS or len(held) >= CHUNK_SETS:
            yield held
            held, size = [], 0
    if held:
        yield held


def prefix_table(docs: DataFrame, n: int, percent: int, frequent: Broadcast) -> DataFrame:
    """doc_id, set_id (null for the empty set), n, and the candidate order's prefix in its order of every row."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known = WordHashes(), frequent.value
        for b in batches:
            texts = b.column("text")
            for held in _chunks((i, shingle_hashes(texts[i].as_py(), n, hashes)) for i in range(b.num_rows)):
                first = [Prefixes(s, known, percent).first(0, 1) for _, s in held]
                ids = b.column("doc_id").slice(held[0][0], len(held))
                yield pa.record_batch([ids, pa.array([set_id(s) if len(s) else None for _, s in held], pa.int64()), pa.array([len(s) for _, s in held], pa.int64()), _lists(first)], names=["doc_id", "set_id", "n", "prefix"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(build, "doc_id long, set_id long, n long, prefix array<long>")


def set_id(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def needed_sets(docs: DataFrame, ids: DataFrame, n: int, percent: int, frequent: Broadcast) -> DataFrame:
    """set_id, tokens, sketch and every order's prefix (p0, p1, p2; 32 bits of each token) of every class in ``ids`` (set_id, first).

    A Bloom filter over the classes' first doc_ids picks the rows that are read again; what passes by
    chance only costs space. Rows without an id always pass. Of classes that were read several times
    one row is kept; no other set is shuffled.
    """
    bits = min(MAX_FILTER_BITS, max(1 << 16, 1 << (BITS_PER_SET * ids.count()).bit_length()))
    places = lambda key: [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) for i in range(FILTER_HASHES)]
    bit = F.col("bit")
    cells = ids.filter("first IS NOT NULL").select(F.explode(F.array(*places("first"))).alias("bit"))
    cells = cells.select(F.floor(bit / 32).cast("int").alias("cell"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 32).cast("int")).alias("mask"))
    rows = cells.groupBy("cell").agg(F.bit_or("mask").alias("mask")).toArrow()  # MAX_FILTER_BITS / 32 rows at most
    bitmap = np.zeros(bits // 32, np.uint32)
    bitmap[rows.column("cell").to_numpy()] = rows.column("mask").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)
    orders = range(len(ORDERS))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, cells, known = WordHashes(), sent.value, frequent.value
        for b in batches:
            texts, pick = b.column("text"), np.ones(b.num_rows, bool)
            for i in range(FILTER_HASHES):
                place = b.column(f"bit{i}").to_numpy()
                pick &= (cells[place // 32] >> (place % 32).astype(np.uint32) & np.uint32(1)).astype(bool)
            pick |= b.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            for held in _chunks((i, shingle_hashes(texts[i].as_py(), n, hashes)) for i in np.flatnonzero(pick).tolist()):
                sets = [s for _, s in held if len(s)]
                made = [Prefixes(s, known, percent) for s in sets]
                prefixes = [_lists([x.first(k, COMMON).astype(np.int32) for x in made], np.int32) for k in orders]
                yield pa.record_batch([pa.array([set_id(s) for s in sets], pa.int64()), _lists(sets), _lists([sketch(s) for s in sets]), *prefixes], names=["set_id", "tokens", "sketch", *[f"p{k}" for k in orders]])

    arrays = "".join(f", p{k} array<int>" for k in orders)
    keyed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).select("*", *[p.alias(f"bit{i}") for i, p in enumerate(places("doc_id"))])
    made = materialize(keyed.mapInArrow(build, f"set_id long, tokens array<long>, sketch array<long>{arrays}"), "ngram-sets")
    several = materialize(made.groupBy("set_id").count().filter("count > 1").select("set_id"), "ngram-several")
    if several.isEmpty():
        return made
    return made.join(several, "set_id", "left_anti").union(materialize(made.join(several, "set_id", "left_semi").dropDuplicates(["set_id"]), "ngram-sets"))


def _overlap(n_a: Column, n_b: Column, percent: int) -> Column:
    """The least number of common tokens of two similar sets of these sizes."""
    return F.floor((percent * (n_a + n_b) + (100 + percent - 1)) / (100 + percent))


def _pairs(x: str, y: str, percent: int) -> Column:
    """(a, b, n_a, n_b) of two rows of a token (id, n, pos), the smaller set first; null where the token
    stands too late in one of them to be the pair's first common one, or both are the same class."""
    x, y = F.col(x), F.col(y)
    least = _overlap(x["n"], y["n"], percent)
    fits = (x["id"] != y["id"]) & (x["pos"] <= x["n"] - least) & (y["pos"] <= y["n"] - least)
    first = (x["n"] < y["n"]) | ((x["n"] == y["n"]) & (x["id"] < y["id"]))
    pair = lambda p, q: F.struct(p["id"].alias("a"), q["id"].alias("b"), p["n"].alias("n_a"), q["n"].alias("n_b"))
    return F.when(fits, F.when(first, pair(x, y)).otherwise(pair(y, x)))


def _bucket_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs within each token of ``rows`` (token, x: id, n, pos); a token has MAX_BUCKET rows at most."""
    lists = rows.groupBy("token").agg(F.collect_list("x").alias("m"))
    one = lists.select("m", F.posexplode("m").alias("i", "x"))
    two = one.select("x", F.explode(F.slice("m", F.col("i") + 2, F.lit(MAX_BUCKET))).alias("y"))
    return two.select(_pairs("x", "y", percent).alias("p")).filter("p IS NOT NULL").select("p.*")


def _pivot_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of every row with three pivots of its token: the row where the token stands first, the smallest and the largest set."""
    x = F.col("x")
    by = [F.struct(x["pos"].alias("k"), x["n"].alias("l"), x["id"].alias("m")), F.struct(x["n"].alias("k"), x["pos"].alias("l"), x["id"].alias("m")), F.struct((-x["n"]).alias("k"), x["pos"].alias("l"), x["id"].alias("m"))]
    pivots = rows.groupBy("token").agg(F.array_distinct(F.array(*[F.min_by("x", k) for k in by])).alias("pivots"))
    both = rows.join(pivots, "token").select("x", F.explode("pivots").alias("y"))
    return both.select(_pairs("x", "y", percent).alias("p")).filter("p IS NOT NULL").select("p.*")


def _across_pairs(rows: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs of each token's rows in different components; a pair inside the token's largest component is never made."""
    rooted = rows.join(roots.withColumnRenamed("node", "__node"), F.col("x.id") == F.col("__node"), "left")
    rooted = materialize(rooted.select("token", "x", F.coalesce("root", "x.id").alias("root")), "ngram-rooted")
    parts = rooted.groupBy("token", "root").count().groupBy("token").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count("*").alias("parts"))
    mixed = rooted.join(parts.filter("parts > 1").drop("parts"), "token")
    rest = mixed.filter("root <> main").select("token", F.col("x").alias("y"), F.col("root").alias("other"))
    # two rows outside the main component meet once
    both = mixed.join(rest, "token").filter("root <> other AND (root = main OR x.id < y.id)")
    return both.select(_pairs("x", "y", percent).alias("p")).filter("p IS NOT NULL").select("p.*").distinct()


def _with_both(pairs: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` with the columns of both their sets; only what the pairs need is shuffled where they are few."""
    side = lambda k: sets.select(F.col("set_id").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in columns])
    return pairs.join(side("a"), "a").join(pairs.select("a", "b").join(side("b"), "b"), ["a", "b"])


def close_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b, n_a, n_b) whose sketches differ in no more bits than similar sets may in tokens.

    Each odd bit of two sketches' exclusive or is at least one token that only one set has. The larger
    of two sketches is folded, which halves it: similar sets' sizes differ by less than a factor of two.
    """
    half = lambda s: (F.size(s) / 2).cast("int")
    both = lambda x, y: F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q))
    fold = lambda s, t: F.when(F.size(s) > F.size(t), both(F.slice(s, F.lit(1), half(s)), F.slice(s, half(s) + 1, half(s)))).otherwise(F.col(s))
    odd = F.aggregate(both(fold("sketch_a", "sketch_b"), fold("sketch_b", "sketch_a")), F.lit(0), lambda n, x: n + F.bit_count(x))
    most = F.col("n_a") + F.col("n_b") - 2 * _overlap(F.col("n_a"), F.col("n_b"), percent)
    return _with_both(pairs, sets, ["sketch"]).filter(odd <= most).select("a", "b", "n_a", "n_b")


def filtered_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b, n_a, n_b) whose prefixes share enough tokens under every order."""
    orders = [f"p{k}" for k in range(len(ORDERS))]
    held = _with_both(pairs, sets, orders)
    least = _overlap(F.col("n_a"), F.col("n_b"), percent)
    early = lambda p, k: F.slice(f"{p}_{k}", F.lit(1), (F.col(f"n_{k}") - least + COMMON).cast("int"))
    for p in orders:
        held = held.filter(F.size(F.array_intersect(early(p, "a"), early(p, "b"))) >= F.least(F.lit(COMMON), least))
    return held.select("a", "b", "n_a", "n_b")


def verified_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose whole sets are similar."""
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return _with_both(pairs, sets, ["tokens"]).filter(100 * common >= percent * (F.col("n_a") + F.col("n_b") - common)).select("a", "b")


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    Documents link when 100 * intersection >= percent * union of their n-gram sets; component_id is
    the smallest doc_id reachable by links. Null, empty and wordless texts have empty sets, link with
    nothing, and stand for themselves. Repeated rows are rows of one class; a null doc_id takes the
    component of its copies and else stays null. Other columns are ignored. The result is written
    to the shared folder, and every other scratch table is deleted.
    """
    with scratch_scope(docs.sparkSession) as keep:
        return keep(_components(docs, n, percent), "ngram-components")


def _components(docs: DataFrame, n: int, percent: int) -> DataFrame:
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_tokens(docs, n))  # MAX_FREQUENT rows at most
    table = materialize(prefix_table(docs, n, percent, frequent), "ngram-prefixes")
    classes = table.filter("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"))
    classes = materialize(classes, "ngram-classes")
    copied = classes.filter("rows > 1").select("set_id", "first")
    # one row of each class goes on
    one = table.filter("set_id IS NOT NULL").join(copied, "set_id", "left").filter(F.col("first").isNull() | (F.col("first") == F.col("doc_id")))
    tokens = one.select(F.posexplode("prefix").alias("pos", "token"), "set_id", "n").select("token", F.struct(F.col("set_id").alias("id"), F.col("n").cast("int").alias("n"), "pos").alias("x"))
    sizes = materialize(tokens.groupBy("token").count().filter("count > 1"), "ngram-sizes")
    shared = materialize(tokens.join(sizes, "token"), "ngram-shared")
    large = shared.filter(F.col("count") > MAX_BUCKET).select("token", "x")
    near = _bucket_pairs(shared.filter(F.col("count") <= MAX_BUCKET), percent).union(_pivot_pairs(large, percent))
    near = materialize(near.distinct(), "ngram-pairs")

    def with_sets(pairs: DataFrame, have: DataFrame | None) -> DataFrame:
        """The sets that ``pairs`` need, read again from the texts where ``have`` lacks them."""
        ids = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
        ids = ids if have is None else ids.join(have.select("set_id"), "set_id", "left_anti")
        needed = materialize(classes.select("set_id", "first").join(ids, "set_id", "left_semi"), "ngram-needed")
        if have is not None and needed.isEmpty():
            return have
        more = needed_sets(docs, needed, n, percent, frequent)
        return more if have is None else have.union(more)

    def grow(pairs: DataFrame, links: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """All links so far and their components, after ``pairs`` are filtered and verified."""
        held = materialize(filtered_pairs(pairs, sets, percent), "ngram-filtered")
        new = verified_links(held, sets, percent)
        links = materialize(new if links is None else new.union(links), "ngram-links")
        return links, materialize(connected_components(links), "ngram-roots")

    def apart(pairs: DataFrame) -> DataFrame:
        root = lambda k: roots.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}"))
        both = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
        return both.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).drop("root_a", "root_b")

    sets = with_sets(near, None)
    left = materialize(close_pairs(near, sets, percent), "ngram-candidates")
    # each class with one of its candidates first, then whatever is left between different components
    single = left.groupBy("b", "n_b").agg(F.min(F.struct("a", "n_a")).alias("x")).select("x.a", "b", "x.n_a", "n_b")
    single = materialize(single, "ngram-single")
    links, roots = grow(single, None)
    left = materialize(apart(left.join(single.select("a", "b"), ["a", "b"], "left_anti")), "ngram-candidates")
    links, roots = grow(left, links)
    if not large.isEmpty():
        across = materialize(_across_pairs(large, roots, percent).join(near.select("a", "b"), ["a", "b"], "left_anti"), "ngram-across")
        sets = with_sets(across, sets)
        links, roots = grow(materialize(close_pairs(across, sets, percent), "ngram-candidates"), links)

    firsts = classes.select("set_id", "first")
    named = roots.join(firsts, roots["node"] == firsts["set_id"])
    least_id = named.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = named.join(least_id, "root").select("set_id", "component_id")
    labels = linked.union(copied.join(linked, "set_id", "left_anti").select("set_id", F.col("first").alias("component_id")))
    # rows of unlinked classes need no label
    out = table.select("doc_id", "set_id", "n").join(labels, "set_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """The rows of ``docs`` whose doc_id is its component's id: one document of each group.

    Rows that share a doc_id share a fate: all stay, or all go if one of them is in another's group.
    Rows with a null doc_id stay.
    """
    found = jaccard_components(docs, n, percent)
    gone = found.filter(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
