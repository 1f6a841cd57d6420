"""64-bit hashes of the words of texts, many at a time in numpy."""

from __future__ import annotations

import hashlib

import numpy as np

_B = np.uint64(0x9E3779B97F4A7C15)
_ODD = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
PIECE = 1 << 20
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * _ODD[0]
    h = (h ^ (h >> np.uint64(27))) * _ODD[1]
    return h ^ (h >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, PIECE + 1)
        inverse = np.uint64(pow(int(_B), -1, 1 << 64))
        for name, base in (("up", _B), ("down", inverse)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=np.uint64)
        _powers["byte"] = mixed(np.arange(1, 257, dtype=np.uint64) * _ODD[1])
    return _powers["up"], _powers["down"], _powers["byte"]


def _pieces(data: bytes):
    """Parts of ``data`` of about ``PIECE`` bytes, cut at white space."""
    at = 0
    while at < len(data):
        end = at + PIECE
        while end < len(data) and not _SPACES[data[end]]:
            end += 1
        yield data[at:end]
        at = end


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z lower-cased first."""
    return byte_word_hashes((text or "").encode("utf-8", "surrogatepass").translate(LOWER))


def byte_word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words of a text in bytes, as they are."""
    out = []
    for piece in _pieces(data):
        up, down, byte = _tables(len(piece) + 1)
        codes = np.frombuffer(piece, np.uint8)
        edge = np.diff(np.concatenate([[False], ~_SPACES[codes], [False]]).astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(byte[codes] * up[:len(codes)], out=sums[1:])
        out.append(mixed((sums[end] - sums[start]) * down[start]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``size`` words; fewer words are one run."""
    if not len(words):
        return words
    k = min(size, len(words))
    h = np.full(len(words) - k + 1, k, np.uint64)
    for j in range(k):
        h = mixed(h * _B + words[j:len(words) - k + 1 + j])
    return np.unique(h)


def set_key(shingle_set: np.ndarray) -> int:
    """Signed 64-bit key of a set."""
    return int.from_bytes(hashlib.blake2b(shingle_set.tobytes(), digest_size=8).digest(), "little", signed=True)
