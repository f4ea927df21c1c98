"""SentencePiece encoding that keeps, for every piece, the span of source bytes it came from.

The text is normalised here: at each place the longest prefix that the model's compiled character
map knows is replaced, and the source place of every normalised byte is recorded. White space then
becomes the model's mark, and the pieces' lengths, added up over the normalised bytes, are projected
through that record to spans of the source. The segmentation itself is the library's: each distinct
chunk between merge barriers is encoded once by a copy of the model whose own normaliser is off.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Fixed value: the character that stands for a blank in pieces.
MARK = "▁"


def charsmap_entries(blob: bytes) -> dict[bytes, bytes]:
    """The rules of a compiled character map: key bytes and their replacement.

    The map is a little-endian length, a double-array trie of 32-bit units, and NUL-terminated
    replacements; the trie is walked once, breadth first.
    """
    if not blob:
        return {}
    size = struct.unpack_from("<I", blob)[0]
    units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
    strings = blob[4 + size :]
    offset = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
    rules: dict[bytes, bytes] = {}
    todo = [(offset(units[0]), b"")]
    while todo:
        at, key = todo.pop()
        for c in range(256):
            child = at ^ c
            if child >= len(units) or (units[child] & 0x800000FF) != c or (c == 0 and not key):
                continue
            if c == 0:  # the unit of a value
                start = units[at] & 0x7FFFFFFF
                rules[key] = strings[start : strings.index(b"\0", start)]
            else:
                node = child ^ offset(units[child])
                key_c = key + bytes([c])
                if (units[child] >> 8) & 1:
                    start = units[node] & 0x7FFFFFFF
                    rules[key_c] = strings[start : strings.index(b"\0", start)]
                todo.append((node, key_c))
    return rules


class Normalizer:
    """Longest-prefix normalisation with a record of the source place of each normalised byte."""

    def __init__(self, rules: dict[bytes, bytes], dummy_prefix: bool, squeeze_blanks: bool, suffix_mark: bool = False):
        self.rules = {k.decode(): v.decode() for k, v in rules.items()}
        self.dummy_prefix, self.squeeze, self.suffix_mark = dummy_prefix, squeeze_blanks, suffix_mark
        keys = sorted(self.rules, key=lambda k: (-len(k), k))  # the first alternative that matches is the longest
        heads: dict[str, list[str]] = {}
        for k in keys:
            heads.setdefault(k[0], []).append(k[1:])
        single = "".join(re.escape(h) for h, rest in heads.items() if rest == [""])
        several = [f"{re.escape(h)}(?:{'|'.join(map(re.escape, rest))})" for h, rest in heads.items() if rest != [""]]
        self.match = re.compile("|".join([*several, *([f"[{single}]"] if single else [])])) if keys else None

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text with marks for blanks, and for each of its bytes, and its end, the source byte offset."""
        pieces: list[tuple[str, int, int]] = []  # replacement, source start and length in bytes; kept stretches have length -1
        if self.match is None:
            pieces.append((text, 0, -1))
        else:
            at = at_bytes = 0
            for m in self.match.finditer(text):
                kept = text[at : m.start()]
                if kept:
                    pieces.append((kept, at_bytes, -1))
                    at_bytes += len(kept.encode())
                length = len(m.group().encode())
                pieces.append((self.rules[m.group()], at_bytes, length))
                at, at_bytes = m.end(), at_bytes + length
            pieces.append((text[at:], at_bytes, -1))
        out, places = [], []
        for new, start, length in pieces:
            raw = np.frombuffer(new.encode(), np.uint8)
            out.append(raw)
            places.append(start + np.arange(len(raw)) if length < 0 else np.full(len(raw), start))
        raw, place = np.concatenate(out), np.concatenate(places)
        end = len(text.encode())
        if self.squeeze:  # leading, trailing and repeated blanks go
            blank = raw == 32
            keep = ~(blank & np.concatenate([[True], blank[:-1]]))
            raw, place = raw[keep], place[keep]
            if len(raw) and raw[-1] == 32:
                end = int(place[-1])
                raw, place = raw[:-1], place[:-1]
        if self.dummy_prefix and len(raw):
            at = np.asarray([32], np.uint8)
            raw, place = (np.concatenate([raw, at]), np.concatenate([place, [end]])) if self.suffix_mark else (np.concatenate([at, raw]), np.concatenate([place[:1], place]))
        wide = np.where(raw == 32, 3, 1)
        return raw.tobytes().decode().replace(" ", MARK), np.concatenate([np.repeat(place, wide), [end]]).astype(np.int64)


class PieceCoder:
    """Encodes and decodes texts exactly as the library does with the model at ``path``."""

    def __init__(self, path: str, max_chunks: int = 250_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            proto = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        spec = proto.normalizer_spec
        self.normalize = Normalizer(charsmap_entries(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces, proto.trainer_spec.treat_whitespace_as_suffix)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces = b"", False, False
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        byte_piece = proto.SentencePiece.BYTE
        user_defined = any(p.type == proto.SentencePiece.USER_DEFINED for p in proto.pieces)
        self.unknown = self.plain.unk_id()
        self.lengths = np.asarray([1 if p.type == byte_piece else len(p.piece.encode()) for p in proto.pieces], np.int64)
        # pieces never join across a border before a mark, nor beside a character that no longer piece holds
        joined = [p.piece for p in proto.pieces if p.type == proto.SentencePiece.NORMAL and len(p.piece) > 1]
        self.splits = proto.trainer_spec.model_type == proto.trainer_spec.BPE and not user_defined and not any(MARK in p.lstrip(MARK) for p in joined)
        barrier = not any("\n" in p for p in joined)
        self.chunks = re.compile(rf"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+" if barrier else rf"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
        self.max_chunks = max_chunks
        self.memo: dict[str, tuple[list[int], str]] = {}

    def _learn(self, wanted: set[str]) -> None:
        if len(self.memo) + len(wanted) > self.max_chunks:
            self.memo.clear()
        new = sorted(wanted - self.memo.keys())
        for chunk, ids in zip(new, self.plain.encode(new, num_threads=1)):
            self.memo[chunk] = (ids, ",".join(map(str, ids)))

    def encode(self, texts: list[str]) -> list[tuple[list[int], str, np.ndarray, str]]:
        """For each text: its ids, the same as decimal text, the source place of each normalised byte, and the normalised text."""
        normal = [self.normalize(t) for t in texts]
        parts = [self.chunks(n) if self.splits else [n][: bool(n)] for n, _ in normal]
        self._learn(set().union(*parts))
        out = []
        for p, (n, places) in zip(parts, normal):
            known = [self.memo[c] for c in p]
            out.append(([i for ids, _ in known for i in ids], ",".join([s for _, s in known]), places, n))
        return out

    def spans(self, ids: list[int], places: np.ndarray, normal: str) -> np.ndarray:
        """Source byte spans (begin, end) of the pieces, one row each; together they cover the text in order."""
        lengths = self.lengths[np.asarray(ids, np.int64)] if ids else np.zeros(0, np.int64)
        if self.unknown in ids:  # an unknown piece has the length of what it stands for
            rest, at = normal, 0
            lengths = lengths.copy()
            for k, i in enumerate(ids):
                if i == self.unknown:
                    upto = len(rest) if k + 1 == len(ids) else rest.find(self.plain.id_to_piece(ids[k + 1]), at + 1)
                    lengths[k] = len(rest[at:upto].encode())
                    at = upto
                else:
                    at += len(self.plain.id_to_piece(i))
        ends = np.cumsum(lengths)
        return np.stack([places[ends - lengths], places[ends]], axis=1)


_coders: dict[str, PieceCoder] = {}


def coder(path: str) -> PieceCoder:
    """One coder for each worker process and model."""
    if path not in _coders:
        _coders[path] = PieceCoder(path)
    return _coders[path]


def encode_pieces(docs: DataFrame, model: str, batch: int = 256) -> DataFrame:
    """``docs`` (doc_id, text) with ids, begins and ends (source byte spans) of every piece of the whole text.

    A null text is the empty one, which has no pieces; repeated rows stay rows; the other columns are dropped.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ours = coder(model)
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                got = ours.encode([t or "" for t in part.column("text").to_pylist()])
                spans = [ours.spans(ids, places, normal) for ids, _, places, normal in got]
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([s[:, 0] for s in spans], pa.list_(pa.int64())), pa.array([s[:, 1] for s in spans], pa.list_(pa.int64()))],
                    names=["doc_id", "ids", "begins", "ends"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, "doc_id long, ids array<int>, begins array<long>, ends array<long>")


def piece_digests(docs: DataFrame, model: str, batch: int = 256) -> DataFrame:
    """``docs`` (doc_id, text and any others, all kept) with digests of their pieces, spans and decoded text.

    Adds n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of decode(ids)),
    spans_crc32 (of all begins and ends as little-endian 64-bit integers) and spans_cover (whether the
    spans are in order, without gaps, over all source bytes that the normaliser keeps). A null text is
    the empty one. Columns of these names in ``docs`` are replaced.
    """
    made = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "spans_crc32": pa.int64(), "spans_cover": pa.bool_()}
    docs = docs.drop(*made)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ours = coder(model)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                rows = []
                for ids, text, places, normal in ours.encode([t or "" for t in part.column("text").to_pylist()]):
                    spans = ours.spans(ids, places, normal)
                    cover = not ids or bool((spans[1:, 0] == spans[:-1, 1]).all() and spans[0, 0] == places[0] and spans[-1, 1] == places[-1])
                    rows.append((len(ids), sha(text), sha(ours.library.decode(ids) if ids else ""), zlib.crc32(spans.astype("<i8").tobytes()), cover))
                yield pa.record_batch([*part.columns, *[pa.array(c, t) for c, t in zip(zip(*rows), made.values())]], names=[*part.schema.names, *made])

    out = StructType(list(docs.schema.fields))
    for name, kind in (("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string"), ("spans_crc32", "long"), ("spans_cover", "boolean")):
        out = out.add(name, kind)
    return docs.mapInArrow(digest, out)
