"""Word shingles of a text as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
WIDTH = 5
_blank = np.zeros(256, bool)
_blank[[32, *range(9, 14)]] = True
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, BASE, np.uint64))])
            _inverses = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, INVERSE, np.uint64))])


def mixed(x: np.ndarray) -> np.ndarray:
    """Every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """One hash per word, in order; words end at spaces and at tab to carriage return."""
    return byte_word_hashes((text or "").encode("utf-8", "surrogatepass"))[0]


def byte_word_hashes(encoded: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word its hash and where its bytes start and end."""
    raw = np.frombuffer(encoded, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.concatenate([[False], ~_blank[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    _grow(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers[:len(raw)])])
        return mixed((sums[ends] - sums[starts]) * _inverses[starts] + (ends - starts).astype(np.uint64)), starts, ends


def windows(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The hash of each run of ``width`` words; of all words if they are fewer, of nothing if there are none."""
    n = max(len(words) - width + 1, min(len(words), 1))
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(width, len(words))):
            out = out * np.uint64(BASE) + words[k:k + n]
    return mixed(out)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The different shingles of a text, sorted."""
    return np.unique(windows(word_hashes(text), width))


def minhash(shingles: np.ndarray, multipliers: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each hash function the smallest value over the shingles (which must not be empty)."""
    out = np.full(len(multipliers), np.iinfo(np.uint32).max, np.uint32)
    with np.errstate(over="ignore"):
        for start in range(0, len(shingles), 4_096):
            part = shingles[None, start:start + 4_096] * multipliers[:, None] + offsets[:, None]
            np.minimum(out, (part >> np.uint64(32)).astype(np.uint32).min(1), out=out)
    return out


def hash_functions(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, count, np.uint64)
