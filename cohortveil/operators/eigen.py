"""Leading eigenpairs of a symmetric, non-negative operator whose vectors are packed DataFrames (see ``blocks``).

A basis and what the operator makes of it stand side by side, ``q`` and ``aq``.
Each step takes the best approximations that the basis holds, and adds what they
lack (their residuals) to it.  A full basis is restarted from its best vectors.
The residuals bound the eigenvalues' error, so the solver ends when these are
small or the space is spent, and never silently before.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept
from .blocks import changed, inner, noise

WIDTH, MOST = 16, 8


def scaling(gram: np.ndarray, least: float = 1e-10, floor: float = 0.0) -> np.ndarray:
    """What makes vectors of these inner products orthonormal; columns of directions that are spent (shorter than ``floor``, or dependent but for ``least``) are 0."""
    length = np.sqrt(np.maximum(np.diag(gram), 0))
    unit = np.where(length > floor, 1 / np.where(length > floor, length, 1.0), 0.0)
    values, vectors = np.linalg.eigh(unit[:, None] * (gram + gram.T) / 2 * unit)
    good = values > least
    return unit[:, None] * vectors * np.where(good, 1 / np.sqrt(np.where(good, values, 1.0)), 0.0)


def _orthonormal(frame: DataFrame, size: int, width: int, floors: dict[str, float]) -> DataFrame:
    """``q, aq, w`` with ``w`` made orthogonal to ``q`` and orthonormal in itself (twice, against rounding)."""
    columns = {"q": size, "aq": size, "w": width}
    for nth in range(2):
        joint = changed(frame, lambda cohort, m: {"w": m["w"], "b": np.hstack((m["q"], m["w"]))}, columns, ("w", "b"))
        found = inner(joint, "b", "w", (size + width, width))

        def change(cohort: str, m: dict, found=found, nth=nth) -> dict:
            off, own = found[cohort][:size], found[cohort][size:]
            return m | {"w": (m["w"] - m["q"] @ off) @ scaling(own - off.T @ off, *((1e-10, floors.get(cohort, 0.0)) if nth == 0 else (1e-4, 1e-4)))}

        frame = changed(frame, change, columns, ("q", "aq", "w"))
    return kept(frame)


def leading(rows: DataFrame, apply: Callable[[DataFrame, int], DataFrame], k: int = 1, tolerance: float = 1e-7, width: int = WIDTH, most: int = MOST, steps: int = 200) -> tuple[dict[str, np.ndarray], DataFrame, int]:
    """The ``k`` largest eigenvalues of each cohort (fewer if its space is smaller) and their vectors ``cohort, st, ids, v``, with how many columns these have.

    ``rows`` has ``cohort, st, ids``; ``apply`` takes ``cohort, st, ids, v`` and the
    number of its columns to the operator's products.  A residual is small at
    ``tolerance`` of the largest eigenvalue.  ``most`` blocks of ``width`` vectors
    fill a basis.  If ``steps`` don't suffice that is an error.
    """
    width = max(width, k)
    start = changed(rows.withColumn("v", rows["ids"]), lambda cohort, m: {"v": noise(m["v"].view(np.int64), np.arange(width) + 1)}, {"v": 1}, ("v",))
    empty = changed(start, lambda cohort, m: {"q": m["v"][:, :0], "aq": m["v"][:, :0], "w": m["v"]}, {"v": width}, ("q", "aq", "w"))
    frame, size = _orthonormal(empty, 0, width, {}), 0
    for _ in range(steps):
        made = apply(frame.select("cohort", "st", "ids", F.col("w").alias("v")), width).select("cohort", "st", F.col("v").alias("aw"))
        joined = frame.join(made, ["cohort", "st"], "left").select("cohort", "st", "ids", "q", "aq", "w", "aw")
        grown = changed(joined, lambda cohort, m: {"q": np.hstack((m["q"], m["w"])), "aq": np.hstack((m["aq"], m["aw"]))}, {"q": size, "aq": size, "w": width, "aw": width}, ("q", "aq"))
        frame, size = kept(grown), size + width
        ritz = {c: np.linalg.eigh((h + h.T) / 2) for c, h in inner(frame, "q", "aq", (size, size)).items()}
        best = {c: (values[::-1], vectors[:, ::-1]) for c, (values, vectors) in ritz.items()}

        def lack(cohort: str, m: dict, best=best) -> dict:
            values, vectors = best[cohort]
            return m | {"w": m["aq"] @ vectors[:, :width] - (m["q"] @ vectors[:, :width]) * values[:width]}

        frame = changed(frame, lack, {"q": size, "aq": size}, ("q", "aq", "w"))
        norms = {c: np.sqrt(np.maximum(np.diag(g), 0)) for c, g in inner(frame, "w", "w", (width, width)).items()}
        floors = {c: 1e-13 * abs(float(values[0])) for c, (values, _) in best.items()}
        if all(norms[c][:k].max(initial=0) <= tolerance * max(abs(float(values[0])), 1e-300) for c, (values, _) in best.items()):
            break
        if size + width > most * width:
            keep = 2 * width
            frame, size = changed(frame, lambda cohort, m, best=best: {"q": m["q"] @ best[cohort][1][:, :keep], "aq": m["aq"] @ best[cohort][1][:, :keep], "w": m["w"]}, {"q": size, "aq": size, "w": width}, ("q", "aq", "w")), keep
        frame = _orthonormal(frame, size, width, floors)
    else:
        raise ArithmeticError(f"the {k} largest eigenvalues aren't settled after {steps} steps")
    vectors = changed(frame, lambda cohort, m, best=best: {"v": m["q"] @ best[cohort][1][:, :k]}, {"q": size, "aq": size, "w": width}, ("v",))
    return {c: values[:k] for c, (values, _) in best.items()}, vectors, k
