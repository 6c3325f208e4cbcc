"""Hashes of words and of runs of words, for whole batches of texts at once in numpy.

Words are runs of bytes other than ASCII white space. A word's hash is a polynomial in its
bytes' random codes modulo 2**64, then mixed; a run's hash is a polynomial in its words'
hashes. Prefix sums give any run's value in constant time."""

from __future__ import annotations

import functools

import numpy as np

#: Fixed odd multipliers (any would do; all executors must use the same).
BYTES, RUN_A, RUN_B = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5
SEGMENT = 1 << 21
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
CODE = np.random.default_rng(35).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(4)
def _powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (base, pow(base, -1, 2**64)):
        p = np.full(1 << bits, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return tuple(out)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of a base, and of its inverse, up to n at least."""
    return _powers(base, max(16, int(n).bit_length()))


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Sums S with S[j] - S[i] = the polynomial of values[i:j], times base ** i."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values))[0][: len(values)], out=out[1:])
    return out


def runs(sums: np.ndarray, base: int, length: int) -> np.ndarray:
    """The polynomial of every run of so many values."""
    n = len(sums) - length
    return mix((sums[length:] - sums[:-length]) * powers(base, len(sums))[1][:n]) if n > 0 else np.empty(0, np.uint64)


def bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~SPACE[buf]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, one text after another, and each text's first word
    (with the total at the end). Long texts are hashed in segments cut at white space."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    group, size = [], 0

    def flush():
        nonlocal group, size
        if group:
            buf = np.frombuffer(b"\n".join(x for _, x in group), np.uint8)
            s, e = bounds(buf)
            sums = prefix(CODE[buf], BYTES)
            hashes.append(mix((sums[e] - sums[s]) * powers(BYTES, len(sums))[1][s]))
            ends = np.cumsum([len(x) + 1 for _, x in group])
            n = np.diff(np.concatenate([[0], np.searchsorted(s, ends)]))
            np.add.at(counts, [i for i, _ in group], n)
            group, size = [], 0

    for i, x in enumerate(texts):
        while len(x) > SEGMENT:
            cut = _last_space(x)
            if cut < 0:
                break
            flush()
            group = [(i, x[:cut])]
            flush()
            x = x[cut + 1 :]
        group.append((i, x))
        size += len(x)
        if size > SEGMENT:
            flush()
    flush()
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), np.concatenate([[0], np.cumsum(counts)])


def _last_space(x: bytes) -> int:
    """The last white space in a text's first segment, else the first one after it."""
    space = np.flatnonzero(SPACE[np.frombuffer(x[:SEGMENT], np.uint8)])
    if len(space):
        return int(space[-1])
    rest = np.flatnonzero(SPACE[np.frombuffer(x, np.uint8)])
    return int(rest[0]) if len(rest) else -1


def within(first: np.ndarray, length: int) -> np.ndarray:
    """For each word but the last ones: does a run of so many words from it stay in its text?"""
    n = max(0, int(first[-1]) - length + 1)
    out = np.zeros(n, bool)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= length:
            out[a : b - length + 1] = True
    return out
