"""Words and word shingles of Arrow text columns, in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Text that is worked on at once; one longer document is a piece of its own.
PIECE_BYTES = 2_000_000
#: Distinct words remembered by a worker.
MEMO_WORDS = 300_000

_WORD = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: Lower-cases A-Z and turns all ASCII but digits and letters into spaces.
WORD_TABLE = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b in _WORD else 0x20 for b in range(256))


def words(raw: bytes) -> list[bytes]:
    """Maximal runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return raw.translate(WORD_TABLE).split()


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def pieces(raws: list[bytes | None], limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about limit bytes."""
    start = held = 0
    for i, raw in enumerate(raws):
        n = len(raw) if raw else 0
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(raws):
        yield start, len(raws)


class WordHashes(dict):
    """word -> 64-bit hash, computed once while there is room."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = value
        return value

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of width consecutive words; empty where there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out *= _P
        out += hashes[k : k + n]
    return mix(out)
