"""The few expressions that Spark SQL and DuckDB spell differently.

Operators write one relational text; Spark runs it, and the same text in the
other dialect is the check's SQL.
"""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def percentile(self, x: str, q: float) -> str:
        """Exact quantile with linear interpolation."""
        return f"percentile({x}, {q})" if self.spark else f"quantile_cont({x}, {q})"

    def draw(self, key: str) -> str:
        """An integer below 2**32 from the md5 of a text key; the same everywhere."""
        return f"cast(conv(substr(md5({key}), 1, 8), 16, 10) as bigint)" if self.spark else f"cast('0x' || substr(md5({key}), 1, 8) as bigint)"

    def uniform(self, key: str) -> str:
        return f"({self.draw(key)} / cast(4294967296 as double))"

    def series(self, name: str, start: int, end: int) -> str:
        """A one-column relation of the integers from start to end."""
        return f"(select cast(id as int) as {name} from range({start}, {end + 1}))" if self.spark else f"(select unnest(range({start}, {end + 1})) as {name})"

    def unnest_range(self, n: str) -> str:
        """The integers from 0 below n, a row each, in a select list."""
        return f"explode(sequence(cast(0 as bigint), {n} - 1))" if self.spark else f"unnest(range(0, {n}))"

    def text(self, x: str) -> str:
        return f"cast({x} as string)" if self.spark else f"cast({x} as varchar)"

    def to_int(self, x: str) -> str:
        return f"try_cast({x} as int)"

    def argmin(self, value: str, *by: str) -> str:
        key = ", ".join(by)
        return f"min_by({value}, struct({key}))" if self.spark else f"arg_min({value}, row({key}))"

    def row(self, **fields: str) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")" if self.spark else "struct_pack(" + ", ".join(f"{k} := {v}" for k, v in fields.items()) + ")"

    def joined(self, value: str, order: str) -> str:
        """Values joined by '|' in the order of a column."""
        return f"array_join(transform(array_sort(collect_list(struct({order} as o, {value} as v))), x -> cast(x.v as string)), '|')" if self.spark else f"string_agg({value}, '|' order by {order})"

    def ranking(self, value: str, order: str) -> str:
        return f"array_join(transform(array_sort(collect_list(struct({order} as o, {value} as v))), x -> x.v), ' > ')" if self.spark else f"string_agg({value}, ' > ' order by {order})"

    def p_text(self, p: str, draws: int, digits: int = 1) -> str:
        """A p value as ``m x10^e`` text, rounded to one digit more first; ``<1x10^-k`` at 0, k from the number of draws."""
        if self.spark:
            parts = f"split(format_string('%.{digits + 1}e', {p}), 'e')"
            told = f"concat(format_number(cast(get({parts}, 0) as double), {digits}), 'x10^', cast(cast(get({parts}, 1) as int) as string))"
        else:
            parts = f"string_split(format('{{:.{digits + 1}e}}', {p}), 'e')"
            told = f"format('{{:.{digits}f}}', cast({parts}[1] as double)) || 'x10^' || cast(cast({parts}[2] as int) as varchar)"
        return f"case when {p} <= 0 then '<1x10^-{math.ceil(math.log10(draws))}' else {told} end"

    def int_div(self, a: str, b: str) -> str:
        return f"({a} div {b})" if self.spark else f"({a} // {b})"


SPARK, DUCKDB = Dialect(True), Dialect(False)


def d(x: float) -> str:
    """A double literal in either dialect."""
    if x in (float("inf"), float("-inf")):
        return f"cast('{'-' if x < 0 else ''}infinity' as double)"
    return f"cast({x!r} as double)"
