"""Draws by the md5 of a key, many at once: what ``Dialect.draw`` gives a key at a time.

Keys that differ in their last digits alone share all but one or two words of
their md5 block, so the rounds run over arrays of keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MASK = 0xFFFFFFFF
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_ADDED = [int(abs(math.sin(i + 1)) * 2**32) & _MASK for i in range(64)]
_TURNED = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_WORD = [i for i in range(16)] + [(5 * i + 1) % 16 for i in range(16)] + [(3 * i + 5) % 16 for i in range(16)] + [(7 * i) % 16 for i in range(16)]
_NUMBER = np.array
_SHIFTS = [_NUMBER(n, np.uint32) for n in range(32)]  # arrays of no dimension: numbers would be made into these at each use
#: The first word of the digest is settled three steps before the last.
_STEPS = 61
#: Digits that differ within an array of keys.
_DIGITS = 4


def _digits(width: int) -> np.ndarray:
    """The numbers of ``width`` digits with leading zeros, as the little-endian words of their characters."""
    numbers = np.arange(10**width, dtype=np.uint32)
    out = np.zeros(10**width, np.uint32)
    for place in range(width):
        out |= (numbers // 10 ** (width - 1 - place) % 10 + 48).astype(np.uint32) << np.uint32(8 * place)
    return out


_TEXTS = {width: _digits(width) for width in range(1, _DIGITS + 1)}


def _first_words(head: bytes, width: int, low: int, high: int) -> np.ndarray:
    """The first 32 bits, as the hex text reads, of the md5 of ``head`` and each number of ``width`` digits from ``low`` below ``high``."""
    size = len(head) + width
    if size > 55:
        raise ValueError("keys are at most 55 bytes here")
    fixed = np.frombuffer((head + b"\0" * width + b"\x80").ljust(56, b"\0") + (8 * size).to_bytes(8, "little"), "<u4").tolist()
    at, shift = len(head) // 4, 8 * (len(head) % 4)
    text = _TEXTS[width][low:high]
    moving = {at: (text << np.uint32(shift)) | np.uint32(fixed[at])}
    if shift + 8 * width > 32:
        moving[at + 1] = (text >> np.uint32(32 - shift)) | np.uint32(fixed[at + 1])
    state = list(_START)
    begin = min(moving)  # until the first word that differs all keys go the same way
    for step in range(begin):
        w, x, y, z = state
        mixed = (w + (z ^ (x & (y ^ z))) + _ADDED[step] + fixed[step]) & _MASK
        turn = _TURNED[step]
        state = [z, (x + (mixed << turn | mixed >> (32 - turn))) & _MASK, x, y]
    a, b, c, d = (np.full(len(text), x, np.uint32) for x in state)
    f, t = np.empty_like(a), np.empty_like(a)
    add, xor, both, either = np.add, np.bitwise_xor, np.bitwise_and, np.bitwise_or
    for step in range(begin, _STEPS):
        word, turn = _WORD[step], _TURNED[step]
        if step < 16:
            xor(c, d, f)
            both(f, b, f)
            xor(f, d, f)
        elif step < 32:
            xor(b, c, f)
            both(f, d, f)
            xor(f, c, f)
        elif step < 48:
            xor(b, c, f)
            xor(f, d, f)
        else:
            np.bitwise_not(d, f)
            either(f, b, f)
            xor(f, c, f)
        add(a, f, a)
        if word in moving:
            add(a, moving[word], a)
            add(a, _NUMBER(_ADDED[step], np.uint32), a)
        else:
            add(a, _NUMBER((_ADDED[step] + fixed[word]) & _MASK, np.uint32), a)
        np.left_shift(a, _SHIFTS[turn], t)
        np.right_shift(a, _SHIFTS[32 - turn], a)
        either(a, t, a)
        add(a, b, a)
        a, b, c, d = d, a, b, c
    return (b + np.uint32(_START[0])).byteswap()


def draws(head: str, first: int, n: int) -> Iterator[np.ndarray]:
    """Draws below 2**32 of the keys ``head`` and each number from ``first`` on, ``n`` in all, by parts."""
    at, end, step = first, first + n, 10**_DIGITS
    while at < end:
        if at < step:
            width = len(str(at))
            stop = min(end, 10**width)
            yield _first_words(head.encode(), width, at, stop)
        else:
            high, low = divmod(at, step)
            stop = min(end, (high + 1) * step)
            yield _first_words(f"{head}{high}".encode(), _DIGITS, low, low + stop - at)
        at = stop


def picked(head: str, first: int, n: int, have: int, edges: np.ndarray) -> np.ndarray:
    """How many of :func:`draws`, modulo ``have``, lie below each of the rising ``edges`` and not below the one before it."""
    out = np.zeros(len(edges) + 1, np.int64)
    for drawn in draws(head, first, n):
        if have <= _MASK:
            drawn = drawn - drawn // np.uint32(have) * np.uint32(have)
        over = drawn[drawn >= edges[0]] if edges[0] <= _MASK else drawn[:0]  # most lie below the first one
        out[0] += len(drawn) - len(over)
        out += np.bincount(np.searchsorted(edges, over.astype(np.int64), "right"), minlength=len(out))
    return out[:-1]


def cells_drawn(chunks: DataFrame) -> DataFrame:
    """``name, kind, b, cell, n, size`` of runs of draws ``name, kind, b, size, have, first, slots, cells, edges``: how many draws of each fall into each cell.

    ``edges`` are where the source's ``cells`` end in their running counts; only
    sums by cell leave a task.
    """

    def count(batches):
        sums: dict = {}
        for batch in batches:
            cells, edges = batch.column("cells"), batch.column("edges")
            for nth, (name, kind, b, size, have, first, slots) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("name", "kind", "b", "size", "have", "first", "slots")), strict=True)):
                got = picked(f"v:{kind}:{b}:", first, slots, have, edges[nth].values.to_numpy())
                for cell, n in zip(cells[nth].as_py(), got.tolist(), strict=True):
                    if n:
                        key = (name, kind, b, cell, size)
                        sums[key] = sums.get(key, 0) + n
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        columns = zip(*((*key, n) for key, n in sums.items()), strict=True) if sums else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)], names=["name", "kind", "b", "cell", "size", "n"])

    found = chunks.mapInArrow(count, "name string, kind string, b int, cell int, size long, n long")
    return found.groupBy("name", "kind", "b", "cell").agg(F.sum("n").cast("double").alias("n"), F.max("size").alias("size"))
