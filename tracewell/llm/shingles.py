"""Word shingles as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hash a worker remembers.
CACHED_WORDS = 200_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _WordHashes()


def words(text: str | None) -> list[bytes]:
    """The words of a text: runs of anything but ASCII white space, A-Z lower-cased."""
    return (text or "").encode().lower().split()


def word_hashes(text: str | None) -> np.ndarray:
    found = words(text)
    return np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """The hash of each run of ``width`` words, in order; with fewer words the whole sequence is one, with none there is none."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(width, len(h)), np.uint64)
    for i in range(min(width, len(h))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return mix(out)


#: Bytes whose words are hashed at a time; a longer word is hashed with what is before it.
HASHED_BYTES = 1 << 20
_rng = np.random.default_rng(20_230_619)
_BYTES = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\f"))
#: Base of the hash of a word, a polynomial of its bytes, and the base's inverse.
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the base and of its inverse; those of usual lengths are made once."""
    size = max(HASHED_BYTES + 1, 1 << (n - 1).bit_length()) if n else 1
    if size not in _POWERS:
        if len(_POWERS) > 1:
            _POWERS.pop(max(_POWERS))
        _POWERS[size] = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, x, np.uint64)])) for x in (_BASE, _UNBASE))
    return tuple(x[:n] for x in _POWERS[size])


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def hash_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of some texts, one text after another, and where each text's begin, the end last.

    Words are those of ``words``, hashed together by sums of a polynomial's terms.
    """
    each = [(t or "").encode() for t in texts]
    data = b"\n".join(each).lower()
    ends = np.cumsum([len(x) + 1 for x in each])
    hashes, places, at = [], [], 0
    while at < len(data):
        stop = at + HASHED_BYTES
        if stop < len(data):
            part = np.frombuffer(data, np.uint8, stop - at, at)
            spaces = np.flatnonzero(_SPACE[part])
            while not len(spaces) and stop < len(data):  # one long word
                part = np.frombuffer(data, np.uint8, min(len(data), stop + HASHED_BYTES) - stop, stop)
                spaces = np.flatnonzero(_SPACE[part]) + (stop - at)
                stop += len(part)
            stop = at + int(spaces[-1]) + 1 if len(spaces) else len(data)
        part = np.frombuffer(data, np.uint8, min(stop, len(data)) - at, at)
        edges = np.flatnonzero(np.diff(_SPACE[part].astype(np.int8), prepend=1, append=1))
        up, down = powers(len(part) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[part] * up[:-1])])
        begin, end = edges[::2], edges[1::2]
        hashes.append(mix((sums[end] - sums[begin]) * down[begin]))
        places.append(begin + at)
        at += len(part)
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(each) + 1, np.int64)
    return np.concatenate(hashes), np.concatenate([[0], np.searchsorted(np.concatenate(places), ends)])


def runs_of(hashes: np.ndarray, begin: np.ndarray, width: int) -> np.ndarray:
    """At each word the hash of the ``width`` words from there within its text; 0 where fewer are left."""
    out = np.zeros(len(hashes), np.uint64)
    n = len(hashes) - width + 1
    if n > 0:
        sums = np.zeros(n, np.uint64)
        for i in range(width):
            sums = sums * np.uint64(_BASE) + hashes[i : i + n]
        out[:n] = mix(sums) | np.uint64(1)
    short = (begin[1:, None] - np.arange(1, width)).ravel()
    out[short[short >= np.repeat(begin[:-1], width - 1)]] = 0
    return out
