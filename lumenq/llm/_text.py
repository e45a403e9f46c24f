"""Word hashing shared by the text operators: numpy over whole texts, no sampling.

Words are maximal runs of bytes other than ASCII white space, which is what
``bytes.split()`` yields.  Every word gets a 64-bit hash from one pass over the
text's bytes; windows of words are hashed from the word hashes.  Hash tables are
generated from a fixed seed so that every executor and every retry agrees.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SEGMENT = 1 << 18  # bytes hashed at a time, so that a very long text costs bounded memory
_STEPS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_BASE, _SEGMENT)
_INV = _powers(np.uint64(pow(int(_BASE), -1, 2**64)), _SEGMENT)

_WINDOW_POW = [(_powers(s, _SEGMENT), _powers(np.uint64(pow(int(s), -1, 2**64)), _SEGMENT)) for s in _STEPS]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: xor-shifts and odd multiplications."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _segments(words: list[bytes]):
    part, size = [], 0
    for w in words:
        if len(w) >= _SEGMENT:  # one enormous word: cut it, then fold the pieces
            if part:
                yield part, None
            yield [w[i : i + _SEGMENT - 1] for i in range(0, len(w), _SEGMENT - 1)], len(w)
            part, size = [], 0
            continue
        if size + len(w) + 1 > _SEGMENT:
            yield part, None
            part, size = [], 0
        part.append(w)
        size += len(w) + 1
    if part:
        yield part, None


def hash_buffer(buf: np.ndarray) -> np.ndarray:
    """Word hashes of a buffer in which one space ends each word."""
    if len(buf) > _SEGMENT:
        return word_hashes(buf.tobytes().split(b" ")[:-1])
    ends = np.flatnonzero(buf == 32)
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[buf] * _POW[: len(buf)], out=total[1:])
    starts = np.empty_like(ends)
    starts[0] = 0
    starts[1:] = ends[:-1] + 1
    return mix((total[ends] - total[starts]) * _INV[starts])


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash for each word, equal for equal words wherever they stand."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    if sum(map(len, words)) + len(words) <= _SEGMENT:
        return hash_buffer(np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8))
    out = []
    for part, whole in _segments(words):
        if whole is None:
            out.append(hash_buffer(np.frombuffer(b" ".join(part) + b" ", dtype=np.uint8)))
        else:
            # Cut at byte offsets: the pieces may hold no space, so the join is unambiguous.
            folded = windows(np.concatenate([_hash_piece(p) for p in part]), len(part))
            out.append(mix(folded + np.uint64(whole)))
    return np.concatenate(out)


def _hash_piece(piece: bytes) -> np.ndarray:
    buf = np.frombuffer(piece, dtype=np.uint8)
    return mix(np.array([(_BYTE[buf] * _POW[: len(buf)]).sum(dtype=np.uint64)], dtype=np.uint64))


def windows(hashes: np.ndarray, width: int, kind: int = 0) -> np.ndarray:
    """A hash of every run of ``width`` consecutive words; ``kind`` 0 and 1 are independent.

    The hash is a polynomial in the window's word hashes, read off prefix sums; past
    the prepared powers the same polynomial is summed term by term.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    up, down = _WINDOW_POW[kind]
    x = hashes if kind == 0 else mix(hashes ^ _STEPS[1])
    if len(hashes) <= _SEGMENT:
        total = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(x * up[: len(hashes)], out=total[1:])
        return mix((total[width:] - total[:n]) * down[:n])
    h = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        h += x[j : j + n] * up[j]
    return mix(h)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of the ASCII-lowered text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    return np.unique(windows(word_hashes(words), min(width, len(words))))
