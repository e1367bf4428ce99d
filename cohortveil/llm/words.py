"""Words of UTF-8 texts and their rolling hashes, as numpy arrays.

Small helpers that the operators call inside Spark tasks.  A text is a
``uint8`` array; words are maximal runs of bytes that a lookup table marks, so
multi-byte characters never split.  Hashes are 64-bit, the same in every
process, and two independent families exist (``salt``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_MASK = (1 << 64) - 1


def _mix_int(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_set(inside) -> np.ndarray:
    return np.array([inside(b) for b in range(256)], dtype=np.bool_)


#: Bytes of words that white space (space, tab to carriage return) ends.
SPACED = _byte_set(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Bytes of words of digits, small letters and all that isn't ASCII.
PLAIN = _byte_set(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: For ``lut[data]``: A-Z in lower case, all else as it is.
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)

_BYTE_CODE = np.array([_mix_int(0xA5A5 + b) for b in range(256)], dtype=np.uint64)


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown as needed."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(1 << 16, 2 * n)
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up, self.down


_BYTES, _WORDS = Powers(_mix_int(11) | 1), Powers(_mix_int(12) | 1)


def utf8_views(column: pa.Array) -> Iterator[np.ndarray]:
    """One ``uint8`` view a row of an Arrow string column, uncopied (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield whole[a:b]


def word_spans(data: np.ndarray, inside: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where words start and end."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    marks = inside[data]
    edges = np.flatnonzero(marks[1:] != marks[:-1]) + 1
    if marks[0]:
        edges = np.concatenate(([0], edges))
    if marks[-1]:
        edges = np.concatenate((edges, [len(data)]))
    return edges[0::2], edges[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, equal for equal bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _BYTES.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of every ``n`` consecutive words, by start."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    up, down = _WORDS.upto(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum((words ^ np.uint64(_mix_int(salt))) * up[: len(words)], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[:count] + np.uint64(_mix_int(salt + n)))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of every ``width`` consecutive ones (all of them, if fewer)."""
    out, have = values, 1
    while have < width and len(out) > 1:
        step = min(have, width - have, len(out) - 1)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """Positions of the grams that are the least of some ``width`` consecutive ones.

    Of equal least grams all are kept, so what is kept of a window depends on
    its content alone.  Fewer grams than ``width`` count as one window.
    """
    if not len(grams):
        return np.zeros(0, np.int64)
    low = sliding_min(grams, width)
    width = len(grams) - len(low) + 1
    # a gram is kept if the largest of the minima of the windows that hold it equals it
    padded = np.concatenate((np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)))
    return np.flatnonzero(~sliding_min(~padded, width) == grams)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a span of ``width`` words from one of ``starts``."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:-1]) > 0
