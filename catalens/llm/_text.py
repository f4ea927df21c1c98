"""Per-document word helpers that run inside tasks: byte words, lower-casing, word hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Folds A-Z and nothing else, on UTF-8 bytes.
FOLD = bytes(range(256)).translate(bytes(i + 32 if 65 <= i <= 90 else i for i in range(256)))


def byte_words(text: str | None) -> list[bytes]:
    """Words between blanks and the characters 9 to 13, which is what splitting bytes does."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def folded_words(text: str | None) -> list[bytes]:
    """byte_words() of the text with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, remembered up to ``limit`` words at a time."""

    def __init__(self, limit: int = 1 << 17):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes | str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes] | list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (in whole arrays)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
