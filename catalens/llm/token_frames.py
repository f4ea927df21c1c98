"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds the ids of a range of documents in ascending doc_id order, as little-endian unsigned
32-bit integers. Each frame holds whole documents (about ``frame_bytes`` of ids) and can be decoded
alone. Zstandard's skippable frames carry the rest, so that any zstandard reader can decode the file:

    frame*   skippable(directory, index block*)   skippable(seek table)

The seek table ends the file, in the layout of the public seekable format: for each frame its
compressed size, decompressed size and checksum (low 32 bits of XXH64 of the content), then the
number of frames, a descriptor byte with bit 7 set (checksums present) and the magic number. An
index block has, for each of INDEX_DOCS documents, its id (or the null mark) and its number of ids,
and is compressed alone; the directory has each block's compressed size, documents and ids. A reader
takes the two tables and the index blocks and frames of the documents that it wants, nothing else.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalens.llm._blobs import attempt_name, open_folder
from catalens.llm._common import materialize, scratch_path

#: Fixed values of the seekable format: the skippable frame's and the seek table's magic numbers.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
#: The id that stands for a null doc_id in the index.
NULL_ID = -(1 << 63)
END_ID = 0
#: Documents of an index block.
INDEX_DOCS = 4096
#: Bytes of ids that a file should hold.
FILE_BYTES = 128 << 20


class Memo:
    """The ids of chunks, in two generations: what the younger lacks is taken over from the older when asked for."""

    def __init__(self, most: int):
        self.most = most
        self.young: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}

    def turn(self) -> None:
        """Begins a new generation where the younger is full."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}

    def missing(self, wanted: set[str]) -> list[str]:
        """Those of ``wanted`` that have to be learned; all others are in the younger generation after."""
        young, old = self.young, self.old
        out = []
        for c in wanted:
            if c in young:
                continue
            if c in old:
                young[c] = old[c]
            else:
                out.append(c)
        return out


class ChunkCoder:
    """Encodes whole texts with a tokenizers file, remembering the ids of chunks it has seen.

    A chunk runs from one blank to the next, and the ids of the chunks, joined, are the ids of the
    text, as the byte-level pattern never joins characters across a blank that follows another
    character. Inside a chunk it never joins a letter and a full stop or the like after it, nor
    anything with a single line end between other characters, so such chunks are put together from
    parts. A text with several blanks together or with blanks after other white space, with separators
    on which regex engines differ, or with an added token's string goes to the library whole.
    """

    def __init__(self, path: str, max_chunks: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.model._resize_cache(0)  # each chunk is asked for once: the library's cache of words would only fill
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.first, self.inner = Memo(max_chunks), Memo(max_chunks)
        self.odd = re.compile(r"[\x1c-\x1f\x85\u180e\u200b\ufeff]").search
        # every inner chunk begins with the one token in it that begins with a blank
        self.leads = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.leads[i] = token.startswith("\u0120")

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, chunk: str) -> tuple[str, list[str]] | None:
        """A shorter chunk and the texts that follow it, which are encoded on their own; None where nothing can be cut off."""
        head, _, tail = chunk.partition("\n")
        if tail and head and not head[-1].isspace() and not tail[0].isspace():
            return head, ["\n", tail]
        stem = chunk.rstrip(".,;:!?")
        if len(stem) < len(chunk) and stem and stem[-1].isalpha():
            return stem, [chunk[len(stem) :]]
        return None

    def _learn(self, memo: Memo, wanted: set[str]) -> None:
        """Adds the ids of ``wanted`` to ``memo``; None for a chunk after or in which borders are not certain."""
        simple: list[str] = []
        made: list[tuple[str, str, list[str]]] = []
        for c in memo.missing(wanted):
            if c.isalpha():
                simple.append(c)
            elif not c or c[-1].isspace() or self.odd(c):
                memo.young[c] = None
            elif parts := self._parts(c):
                made.append((c, *parts))
            else:
                simple.append(c)
        if made:
            self._learn(memo, {head for _, head, _ in made})
            self._learn(self.first, {x for _, _, rest in made for x in rest if x != "\n"})
            known, after, line = memo.young, self.first.young, self.line
            for c, head, rest in made:
                stem, tail = known[head], after[rest[-1]]
                known[c] = None if stem is None or tail is None else stem + tail if len(rest) == 1 else stem + line + tail
        if memo is self.first:
            memo.young.update(zip(simple, self._whole(simple)))
            return
        groups = [simple[at : at + 64] for at in range(0, len(simple), 64)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(["".join([" " + c for c in g]) for g in groups], add_special_tokens=False)):
            ids = np.asarray(e.ids, "<u4")
            raw, cuts = ids.tobytes(), (4 * np.flatnonzero(self.leads[ids])).tolist()
            if len(cuts) == len(group):
                memo.young.update(zip(group, [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)])]))
            else:
                memo.young.update(zip(group, self._whole([" " + c for c in group])))

    @cached_property
    def line(self) -> bytes:
        return self._whole(["\n"])[0]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        parts: list[list[str] | None] = [None if any(x in t for x in self.special) else t.split(" ") for t in texts]
        inner: set[str] = set().union(*[p[1:] for p in parts if p])
        heads = {p[0] for p in parts if p}
        self.inner.turn()
        self.first.turn()
        self._learn(self.inner, inner)
        self._learn(self.first, heads)
        get, head = self.inner.young.__getitem__, self.first.young
        out: list[bytes | None] = []
        for p in parts:
            if p is None:
                out.append(None)
                continue
            try:
                out.append(b"".join([head[p[0]] if p[0] else b"", *map(get, p[1:])]))
            except TypeError:  # one of them is None
                out.append(None)
        left = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(left, self._whole([texts[i] for i in left])):
            out[i] = ids
        return out


_coders: dict[str, ChunkCoder] = {}


def coder(path: str) -> ChunkCoder:
    """One coder for each worker process and vocabulary. The library starts no threads, as Spark deals out the cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _coders:
        _coders[path] = ChunkCoder(path)
    return _coders[path]


def encode_documents(docs: DataFrame, vocabulary: str, borders: list[int] | None = None, batch: int = 256) -> DataFrame:
    """part, doc_id and ``ids`` (binary): the ids of the whole text and the end id 0; null is the empty text.

    The part is the number of ``borders`` (ascending doc_ids) below the doc_id, 0 for a null one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(np.asarray(borders or [], np.int64))  # one number a file

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ours, end, cuts = coder(vocabulary), np.asarray([END_ID], "<u4").tobytes(), sent.value
        for b in batches:
            for at in range(0, b.num_rows, batch):
                rows = b.slice(at, batch)
                texts = [t or "" for t in rows.column("text").to_pylist()]
                keys = rows.column("doc_id")
                part = np.where(keys.is_null(), 0, np.searchsorted(cuts, keys.fill_null(0).to_numpy(zero_copy_only=False)))
                yield pa.record_batch([pa.array(part.astype(np.int32)), keys, pa.array([x + end for x in ours.encode(texts)], pa.binary())], names=["part", "doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, "part int, doc_id long, ids binary")


class FrameWriter:
    """Writes one file; ``add`` documents in order, then ``close``."""

    def __init__(self, stream, frame_bytes: int, level: int = 1):
        self.stream, self.frame_bytes = stream, frame_bytes
        self.codec = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.pending: list[bytes] = []
        self.pending_bytes = 0
        self.frames: list[tuple[int, int, int]] = []
        self.docs, self.counts = array("q"), array("q")

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(NULL_ID if doc_id is None else doc_id)
        self.counts.append(len(ids) // 4)
        self.pending.append(ids)
        self.pending_bytes += len(ids)
        if self.pending_bytes >= self.frame_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.pending:
            raw = b"".join(self.pending)
            packed = self.codec.compress(raw)
            self.stream.write(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.pending, self.pending_bytes = [], 0

    def close(self) -> None:
        self._flush()
        docs, counts = np.asarray(self.docs, "<i8"), np.asarray(self.counts, "<i8")
        parts = range(0, len(docs), INDEX_DOCS)
        blocks = [self.codec.compress(docs[at : at + INDEX_DOCS].tobytes() + counts[at : at + INDEX_DOCS].tobytes()) for at in parts]
        directory = b"".join(struct.pack("<QQQ", len(x), len(docs[at : at + INDEX_DOCS]), int(counts[at : at + INDEX_DOCS].sum())) for at, x in zip(parts, blocks))
        index = struct.pack("<Q", len(blocks)) + directory + b"".join(blocks)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(index)) + index)
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)


class FrameReader:
    """Random access to one file: the seek table and the index's directory are read first, the rest on demand."""

    def __init__(self, stream, size: int):
        self.stream = stream
        stream.seek(size - 9)
        n, flag, magic = struct.unpack("<IBI", stream.read(9))
        if magic != SEEKABLE_MAGIC or not flag & CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums at the end of the file")
        stream.seek(size - 9 - 12 * n)
        self.frames = np.frombuffer(stream.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        at = int(self.offsets[-1])
        stream.seek(at)
        magic, length = struct.unpack("<II", stream.read(8))
        if magic != SKIPPABLE_MAGIC:
            raise ValueError("no index frame after the last frame")
        (blocks,) = struct.unpack("<Q", stream.read(8))
        self.blocks = np.frombuffer(stream.read(24 * blocks), "<u8").reshape(blocks, 3).astype(np.int64)
        self.block_at = at + 16 + 24 * blocks + np.concatenate([[0], np.cumsum(self.blocks[:, 0])])
        self.first_doc = np.concatenate([[0], np.cumsum(self.blocks[:, 1])])
        self.first_id = np.concatenate([[0], np.cumsum(self.blocks[:, 2])])
        self.frame_ends = np.cumsum(self.frames[:, 1])
        self._last: tuple[int, bytes] = (-1, b"")
        self._block: tuple[int, np.ndarray, np.ndarray] = (-1, np.zeros(0, np.int64), np.zeros(0, np.int64))

    def __len__(self) -> int:
        return int(self.first_doc[-1])

    def index(self, i: int) -> tuple[int | None, int, int]:
        """The ``i``-th document's id, the ids of the file before it, and those after it; only its index block is read."""
        k = int(np.searchsorted(self.first_doc, i, side="right")) - 1
        if self._block[0] != k:
            self.stream.seek(int(self.block_at[k]))
            raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.stream.read(int(self.blocks[k, 0]))), "<i8")
            ids, counts = raw.reshape(2, -1)
            self._block = k, ids, int(self.first_id[k]) + np.concatenate([[0], np.cumsum(counts)])
        _, ids, ends = self._block
        at = i - int(self.first_doc[k])
        return (None if ids[at] == NULL_ID else int(ids[at])), int(ends[at]), int(ends[at + 1])

    def frame(self, k: int) -> bytes:
        """The content of frame ``k``, checked against its checksum."""
        if self._last[0] != k:
            self.stream.seek(int(self.offsets[k]))
            raw = zstandard.ZstdDecompressor().decompress(self.stream.read(int(self.frames[k, 0])), max_output_size=int(self.frames[k, 1]))
            if len(raw) != self.frames[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[k, 2]:
                raise ValueError(f"frame {k} does not match its checksum")
            self._last = (k, raw)
        return self._last[1]

    def document(self, i: int) -> bytes:
        """The ids of the ``i``-th document of the file; only its frame is decompressed."""
        return self.ids(*self.index(i)[1:])

    def ids(self, start: int, end: int) -> bytes:
        """The ids from ``start`` to before ``end`` of the file, which one document holds."""
        k = int(np.searchsorted(self.frame_ends, 4 * start, side="right"))
        base = int(self.frame_ends[k] - self.frames[k, 1])
        return self.frame(k)[4 * start - base : 4 * end - base]


def write_token_files(encoded: DataFrame, folder: str, n_files: int, frame_bytes: int = 1 << 18) -> DataFrame:
    """Write ``encoded`` (part, doc_id, ids) to a file for each part, in ascending doc_id order (nulls first).

    Returns the manifest: part, path, n_docs, n_tokens. A retried task writes a file of its own
    name, and only the attempt whose row reached the manifest counts; keep the manifest
    (materialize it) before reading. Ties of doc_id lie in order of their ids' bytes, and in one file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_folder(folder)
        out, stream, docs, tokens, path, part = None, None, 0, 0, None, None

        def finish() -> pa.RecordBatch:
            out.close()
            stream.close()
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([path]), pa.array([docs], pa.int64()), pa.array([tokens], pa.int64())], names=["part", "path", "n_docs", "n_tokens"])

        for b in batches:
            for at, doc_id, ids in zip(b.column("part").to_pylist(), b.column("doc_id").to_pylist(), b.column("ids")):
                if at != part:
                    if out is not None:
                        yield finish()
                    store.create_dir(root, recursive=True)
                    part, docs, tokens, path = at, 0, 0, attempt_name(root, f"tokens-{at:06d}", ".zst")
                    stream = store.open_output_stream(path, compression=None)
                    out = FrameWriter(stream, frame_bytes)
                raw = ids.as_py()
                out.add(doc_id, raw)
                docs, tokens = docs + 1, tokens + len(raw) // 4
        if out is not None:
            yield finish()

    ordered = encoded.repartition(n_files, "part").sortWithinPartitions("part", "doc_id", "ids")
    return ordered.mapInArrow(write, "part int, path string, n_docs long, n_tokens long")


def file_borders(docs: DataFrame, n_files: int) -> list[int]:
    """Ascending doc_ids that divide ``docs`` into about ``n_files`` equal ranges, from the ids alone.

    Ranges found by Spark would encode every text once more to sample them.
    """
    if n_files < 2:
        return []
    found = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [k / n_files for k in range(1, n_files)], max(10_000, 20 * n_files)).alias("b")).first()["b"]
    return sorted(set(found or []))


def read_token_files(manifest: DataFrame, folder: str, per_task: int = INDEX_DOCS) -> DataFrame:
    """doc_id, ids, start (ids of all documents before it) of every document in the manifest's files.

    Files are read in stretches of ``per_task`` documents by independent tasks, each of which
    decompresses only the frames of its stretch and checks them.
    """
    spark = manifest.sparkSession
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    starts = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    stretch = starts.select("path", "start", F.explode(F.sequence(F.lit(0), F.col("n_docs") - 1, F.lit(per_task))).alias("first"))
    tasks = spark.sparkContext.defaultParallelism * 3

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_folder(folder)
        for b in batches:
            for path, start, first in zip(*[b.column(c).to_pylist() for c in ("path", "start", "first")]):
                size = store.get_file_info(path).size
                with store.open_input_file(path) as stream:
                    file = FrameReader(stream, size)
                    upto = min(first + per_task, len(file))
                    for at in range(first, upto, 256):
                        some = range(at, min(at + 256, upto))
                        docs = [file.index(i) for i in some]
                        yield pa.record_batch([pa.array([d for d, *_ in docs], pa.int64()), pa.array([file.ids(a, b) for _, a, b in docs], pa.binary()), pa.array([start + x for _, x, _ in docs], pa.int64())], names=["doc_id", "ids", "start"])

    return stretch.repartition(tasks, "path", "first").mapInArrow(read, "doc_id long, ids binary, start long")


def token_files(spark: SparkSession, docs: DataFrame, vocabulary: str, folder: str | None = None, file_bytes: int = FILE_BYTES) -> tuple[DataFrame, str]:
    """Encode all ``docs`` (doc_id, text) and write their token files; the manifest and the folder.

    Files hold about ``file_bytes`` of ids each, or less where that makes fewer files than tasks run at
    once. A null text is the empty text (one id, the end); repeated rows are documents of their own;
    rows of one doc_id, or without any, share a file; extra columns are ignored; an empty table gives
    an empty manifest.
    """
    folder = folder or scratch_path(spark, "token-files")
    n_bytes = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0  # about as many bytes of ids
    n_files = max(3 * spark.sparkContext.defaultParallelism, -(-n_bytes // file_bytes))
    encoded = encode_documents(docs, vocabulary, file_borders(docs, n_files))
    return materialize(write_token_files(encoded, folder, n_files), "token-manifest"), folder


def token_digests(spark: SparkSession, docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files that token_files() wrote."""
    manifest, folder = token_files(spark, docs, vocabulary)
    read = read_token_files(manifest, folder)
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def crc32_of(ids: list[int]) -> int:
    """What ids_crc32 holds for a list of ids (for tests and readers without Spark)."""
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
