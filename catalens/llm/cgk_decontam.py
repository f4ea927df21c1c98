"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts and items are sequences of word hashes (words in lower case, without punctuation; characters
where a script sets no blanks). The CGK embedding walks over a sequence with a random bit per step and
symbol that says whether to stay or to go on, and writes the symbol it stands on; sequences at a small
edit distance come out at a small Hamming distance with good probability. A document position starts
an item-sized window; its embedding is sampled at a few steps, and a window is a candidate of every
item whose window gives the same symbols at those steps. As an item's window may itself begin with an
edited word, the item is embedded from each of its word offsets. Independent walks and samples are
repeated until the target recall is reached: some sample whole windows of 16 to 128 words, most the
beginning of the walk, where few edits lie between the start and the samples. Candidates are verified
by their exact edit distance.

Items of fewer than SHORT words have too few offsets for that. With at most k edits one of k + 1 equal
pieces of the item is unedited, so they are looked for by all their pieces of that length, which
misses nothing; the same exact verification follows.

The sampled steps are looked at one after another, for all of a batch's windows at once, and
windows that no item can match any more are dropped at once. Nothing is shuffled: the index of one
block of items goes to every task, and there are as many passes as blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from catalens.llm._text import WordHashes, mix

#: Sampled steps of a repetition, and for each repetition the steps of the walk they are taken from.
#: Where no word of the first LAST_STEP/2 or so is edited, a repetition of LAST_STEP steps surely hits; an item
#: of n words gives n starts, which makes the chance that all of them miss at 15 % edited words about 1 %.
SAMPLES, LAST_STEP = 4, 16
WALKS = (*[LAST_STEP] * 6, 32, 64, 128, 256)
#: Items of fewer words are looked for by their pieces.
SHORT = 16
#: An item is found where its words can be turned into a stretch of the text by edits of at most this share of them.
MAX_EDIT_SHARE = 0.2
#: Words in more than this share of a block's items begin no window of an item that has MIN_STARTS others.
COMMON_SHARE, MIN_STARTS = 0.02, 8
#: Items of one block: at most so many words together, which bounds what is sent to tasks (about 30 bytes a word and repetition).
BLOCK_WORDS = 200_000
#: Words of texts that are searched at once.
BATCH_WORDS = 1 << 20

_WORDS = re.compile(r"[^\W_]+").findall
#: Scripts that set no blanks between words: Thai, Lao, Burmese, Khmer, Japanese, Chinese.
_DENSE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_has_dense = re.compile(f"[{_DENSE}]").search
_DENSE_WORDS = re.compile(f"[{_DENSE}]|[^\\W_{_DENSE}]+").findall


def normal_words(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case; each character alone in scripts without blanks."""
    if not text:
        return []
    text = text.lower()
    return _WORDS(text) if text.isascii() or not _has_dense(text) else _DENSE_WORDS(text)


def _step_bits(symbols: np.ndarray, repeat: int, step: int) -> np.ndarray:
    """The walk's random bit for each symbol: whether it goes on after this step."""
    return (mix(symbols ^ np.uint64((repeat * 1009 + step + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(63)).astype(np.int64)


def sampled_steps(repeat: int, samples: int = SAMPLES) -> list[int]:
    """The sampled steps of a repetition: the first and others of its walk, in ascending order."""
    rest = np.random.default_rng(repeat).choice(np.arange(1, WALKS[repeat]), samples - 1, replace=False)
    return [0, *sorted(int(x) for x in rest)]


def window_keys(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, repeat: int, tables: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sampled symbols, hashed step by step, of the windows that begin at ``starts`` (each text ends at ``ends``).

    ``tables`` has, for each sample, the sorted hashes that any item has so far; windows without one are
    dropped. Gives the remaining starts' indexes, their hashes, and all hashes of each sample.
    """
    alive, at = np.arange(len(starts)), starts.copy()
    hashes = np.zeros(len(starts), np.uint64)
    seen: list[np.ndarray] = []
    step = 0
    for k, sample in enumerate(sampled_steps(repeat)):
        while step < sample:
            inside = at < ends[alive]
            symbols = np.where(inside, words[np.minimum(at, len(words) - 1)], np.uint64(0))
            at = at + np.where(inside, _step_bits(symbols, repeat, step), 0)
            step += 1
        inside = at < ends[alive]
        symbols = np.where(inside, words[np.minimum(at, len(words) - 1)], np.uint64(0))
        hashes = mix(hashes ^ symbols ^ np.uint64(k + 1))
        seen.append(np.unique(hashes) if tables is None else hashes)
        if tables is not None:
            table = tables[k]
            found = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
            keep = table[found] == hashes
            alive, at, hashes = alive[keep], at[keep], hashes[keep]
            if not len(alive):
                break
    return alive, hashes, seen


class ItemIndex:
    """One block of items: their words, and for every repetition the keys of their windows."""

    def __init__(self, items: list[tuple[int, list[str]]], max_edit_share: float):
        hashes = WordHashes()
        self.ids = np.asarray([i for i, _ in items], np.int64)
        arrays = [hashes.of(w) for _, w in items]
        self.bounds = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int64)
        self.words = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(items)), np.diff(self.bounds))
        # a window of an item begins at each of its words, but where too little follows; words that
        # many items have begin none, unless an item has few others, as most positions of any text would match them
        offset = np.arange(len(self.words)) - self.bounds[owner]
        length = self.bounds[owner + 1] - self.bounds[owner]
        _, inverse = np.unique(self.words, return_inverse=True)
        pairs = np.unique(inverse * len(items) + owner)
        rare = np.bincount(pairs // len(items))[inverse] <= max(3, COMMON_SHARE * len(items))
        rare |= (np.bincount(owner, rare, len(items)) < MIN_STARTS)[owner]
        begins = np.flatnonzero(rare & (length >= SHORT) & (length - offset >= LAST_STEP // 2))
        self.repeats = []
        for r, walk in enumerate(WALKS):
            starts = begins[(length - offset)[begins] >= walk // 2]
            if not len(starts):
                continue
            _, keys, seen = window_keys(self.words, starts, self.bounds[owner[starts] + 1], r, None)
            order = np.argsort(keys, kind="stable")
            self.repeats.append((r, seen, keys[order], owner[starts][order], offset[starts][order]))
        # pieces of short items: hashes of runs of words, by their length
        pieces: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for k in np.flatnonzero((np.diff(self.bounds) < SHORT) & (np.diff(self.bounds) > 0)).tolist():
            n = len(self.item(k))
            size = n // (int(max_edit_share * n) + 1)
            at = np.arange(0, n - size + 1, size)
            pieces.setdefault(size, []).append((run_hashes(self.item(k), size)[at], np.full(len(at), k), at))
        self.pieces = []
        for size, rows in pieces.items():
            keys, item, at = (np.concatenate(c) for c in zip(*rows))
            order = np.argsort(keys, kind="stable")
            self.pieces.append((size, keys[order], item[order], at[order]))
        # a small bitmap of first symbols, which lets most positions go at once
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[(self.words[begins] & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def item(self, k: int) -> np.ndarray:
        return self.words[self.bounds[k] : self.bounds[k + 1]]

    def candidates(self, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Distinct (position where the item would begin, item) rows over a batch of texts."""
        likely = np.flatnonzero(self.bitmap[(words & np.uint64((1 << 20) - 1)).astype(np.int64)])
        out = []

        def add(spots: np.ndarray, got: np.ndarray, keys: np.ndarray, owner: np.ndarray, offset: np.ndarray) -> None:
            low, high = np.searchsorted(keys, got), np.searchsorted(keys, got, side="right")
            times = high - low
            entry = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            out.append(np.stack([np.repeat(spots, times) - offset[entry], owner[entry]], axis=1))

        for r, tables, keys, owner, offset in self.repeats:
            alive, got, _ = window_keys(words, likely, ends[likely], r, tables)
            add(likely[alive], got, keys, owner, offset)
        for size, keys, owner, offset in self.pieces:
            got = run_hashes(words, size)  # a run across a text's end fails the verification
            spots = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, got), len(keys) - 1)] == got)
            add(spots, got[spots], keys, owner, offset)
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    key = np.full(max(0, len(words) - size + 1), size, np.uint64)
    for k in range(size):
        key = mix(key ^ words[k : len(key) + k]) + np.uint64(k)
    return key


def best_stretch(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """The least number of word edits that turn the item into a stretch of the text, and that stretch (begin, end).

    Of equal distances the stretch that ends first counts.
    """
    n = len(text)
    cost, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    place = np.arange(n + 1)
    for k, symbol in enumerate(item):
        diagonal = cost[:-1] + (text != symbol)
        above = cost[1:] + 1
        use = diagonal <= above
        new = np.concatenate([[k + 1], np.where(use, diagonal, above)])
        origin = np.concatenate([[0], np.where(use, begin[:-1], begin[1:])])
        # insertions into the item: a running minimum along the text
        least = np.minimum.accumulate(new - place)
        at = np.maximum.accumulate(np.where(new - place == least, place, 0))
        cost, begin = least + place, origin[at]
    end = int(np.argmin(cost))
    return int(cost[end]), int(begin[end]), end


def find_items(docs: DataFrame, items: DataFrame, max_edit_share: float = MAX_EDIT_SHARE, keep: str = "hits") -> DataFrame:
    """Search the whole texts of ``docs`` (doc_id, text) for the passages of ``items`` (item_id, text).

    With ``keep="hits"``: one row for each document row and item found in it: doc_id, item_id,
    edits, item_words, begin, end (words of the normalised text; the best stretch, the first of equals).
    With ``keep="clean"``: the rows of ``docs``, all columns, in which nothing is found.
    Null and empty texts hold nothing; items with a null id or without a word are not searched for;
    equal items are found each; repeated rows are searched each. With few words the share allows no
    edit (one from five words on), so such an item is found where it stands unedited.
    """
    hits, clean = None, docs
    for block in _blocks(items, max_edit_share):
        index = docs.sparkSession.sparkContext.broadcast(block)
        if keep == "clean":
            clean = clean.mapInArrow(_searcher(index, max_edit_share, True), clean.schema)
        else:
            fields = [StructField("doc_id", LongType()), StructField("item_id", LongType()), *[StructField(c, IntegerType()) for c in ("edits", "item_words", "begin", "end")]]
            found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_searcher(index, max_edit_share, False), StructType(fields))
            hits = found if hits is None else hits.union(found)
    if keep == "clean":
        return clean
    return hits if hits is not None else docs.sparkSession.createDataFrame([], "doc_id long, item_id long, edits int, item_words int, begin int, end int")


def _blocks(items: DataFrame, max_edit_share: float) -> Iterator[ItemIndex]:
    """The items in blocks of at most BLOCK_WORDS words; the driver holds one block at a time."""
    block: list[tuple[int, list[str]]] = []
    size = 0
    for r in items.select(F.col("item_id").cast("long"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL").toLocalIterator():
        words = normal_words(r["text"])
        if not words:
            continue
        if block and size + len(words) > BLOCK_WORDS:
            yield ItemIndex(block, max_edit_share)
            block, size = [], 0
        block.append((r["item_id"], words))
        size += len(words)
    if block:
        yield ItemIndex(block, max_edit_share)


def _searcher(broadcast, max_edit_share: float, clean: bool):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ItemIndex = broadcast.value
        hashes = WordHashes()
        for b in batches:
            texts = b.column("text").to_pylist()
            at = 0
            while at < len(texts):
                arrays, size, first = [], 0, at
                while at < len(texts) and size < BATCH_WORDS:
                    arrays.append(hashes.of(normal_words(texts[at])))
                    size += len(arrays[-1])
                    at += 1
                found = _verified(index, arrays, max_edit_share) if size else []
                part = b.slice(first, at - first)
                if clean:
                    dirty = {d for d, *_ in found}
                    yield part.filter(pa.array([i not in dirty for i in range(part.num_rows)], pa.bool_()))
                elif found:
                    ids = part.column("doc_id")
                    yield pa.record_batch(
                        [ids.take(pa.array([f[0] for f in found], pa.int64())), pa.array([f[1] for f in found], pa.int64()), *[pa.array([f[k] for f in found], pa.int32()) for k in (2, 3, 4, 5)]],
                        names=["doc_id", "item_id", "edits", "item_words", "begin", "end"],
                    )

    return search


def _verified(index: ItemIndex, arrays: list[np.ndarray], max_edit_share: float) -> list[tuple[int, int, int, int, int, int]]:
    """(row, item_id, edits, item_words, begin, end) of the items that the texts really hold."""
    bounds = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int64)
    owner = np.repeat(np.arange(len(arrays)), np.diff(bounds))
    words = np.concatenate(arrays)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    spots = index.candidates(words, bounds[owner + 1])
    # where an item may lie in a text; overlapping places are searched as one
    places: dict[tuple[int, int], list[list[int]]] = {}
    last = len(words) - 1
    for spot, k in spots.tolist():
        n = int(index.bounds[k + 1] - index.bounds[k])
        slack = int(max_edit_share * n)
        # a window lies in the text of the position that was found, which the item's offset can lead out of
        for r in {int(owner[min(max(x, 0), last)]) for x in (spot, spot + min(n // 2, 4), spot + n - 1)}:
            low, high = max(int(bounds[r]), spot - slack), min(int(bounds[r + 1]), spot + n + slack)
            if high - low < n - slack:
                continue  # too little text
            known = places.setdefault((r, k), [])
            if known and low <= known[-1][1]:  # spots come in ascending order
                known[-1][1] = max(known[-1][1], high)
            else:
                known.append([low, high])
    for (r, k), known in places.items():
        item = index.item(k)
        slack = int(max_edit_share * len(item))
        for low, high in known:
            # with so few edits, all but as many words of the item lie in the stretch
            if np.isin(item, words[low:high]).sum() < len(item) - slack:
                continue
            edits, begin, end = best_stretch(item, words[low:high])
            if edits <= slack and (edits, low - int(bounds[r]) + begin) < best.get((r, k), (1 << 60, 0, 0))[:2]:
                best[(r, k)] = (edits, low - int(bounds[r]) + begin, low - int(bounds[r]) + end)
    return [(r, int(index.ids[k]), e, len(index.item(k)), s, t) for (r, k), (e, s, t) in sorted(best.items())]
