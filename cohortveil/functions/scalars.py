"""Scalar rules of the score algebra, as SQL text for either dialect and as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import d


def clamp01(x: str) -> str:
    """Into 0..1; NaN and NULL give 1, the riskiest."""
    return f"greatest({d(0.0)}, least({d(1.0)}, coalesce({x}, {d(1.0)})))"


def excess(value: str, base: str) -> str:
    """How far a value is above its base, of what is left to 1: 0 if not above."""
    return f"case when {value} <= {base} then {d(0.0)} else {clamp01(f'({value} - {base}) / (1 - {base} + {d(1e-12)})')} end"


def noisy_or(values: tuple[str, ...], weights: tuple[str, ...]) -> str:
    """1 - prod(1 - w r) with weights normalised over the values that aren't NULL; 0 without any."""
    total = " + ".join(f"(case when {v} is null then {d(0.0)} else {w} end)" for v, w in zip(values, weights, strict=True))
    left = " * ".join(f"(1 - coalesce({w} * {v}, {d(0.0)}) / nullif({total}, 0))" for v, w in zip(values, weights, strict=True))
    return f"case when {total} <= 0 then {d(0.0)} else 1 - {left} end"


def calibrate(raw: str, low: str, high: str) -> str:
    """0 at the safe anchor, 100 at the leaky one."""
    return f"100 * {clamp01(f'({raw} - {low}) / greatest({high} - {low}, {d(1e-12)})')}"


def p_format(p: Column, draws: Column | int | None = None, digits: int = 1) -> Column:
    """A p value as ``m x10^e`` text, rounded to one digit more first; ``<1x10^-k`` at 0, k from the number of draws."""
    parts = F.split(F.format_string(f"%.{digits + 1}e", p), "e")
    told = F.concat(F.format_number(F.get(parts, F.lit(0)).cast("double"), digits), F.lit("x10^"), F.get(parts, F.lit(1)).cast("int").cast("string"))
    least = F.lit("<1x10^-∞") if draws is None else F.concat(F.lit("<1x10^-"), F.ceil(F.log10(F.lit(draws) if isinstance(draws, int) else draws)).cast("string"))
    return F.when(p <= 0, least).otherwise(told)


def entropy(p: Column) -> Column:
    """-p ln p, 0 where p isn't above 0; to be summed."""
    return F.when(p > 0, -p * F.log(p)).otherwise(F.lit(0.0))
