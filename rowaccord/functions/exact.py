"""Sums of floating-point numbers that do not depend on the order of the rows.

A double is a whole multiple of a power of two. It is cut at fixed places of its binary expansion into limbs of 42
bits, and the limbs of a column are summed as decimals: without rounding, in any order, in partial aggregates on every
task. Only the last step, from the sums of a group to one double, rounds. Where two tables are compared they must
be cut at the same places, which one scan without a shuffle finds from the extremes of both.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .names import quote

LIMB = 42
_BASE = 2**LIMB
#: From this quotient on all bits of a double lie above the limb.
_ABOVE = 2.0 ** (53 + LIMB)


@dataclass(frozen=True)
class ExactSum:
    """A measure: the sum of a floating-point column, as a double. Nulls do not count; no value at all gives null.

    Infinities and NaN act as they do in a plain sum: NaN or infinities of both signs give NaN.
    """

    column: str


def places(dfs: Sequence[DataFrame], columns: Sequence[str]) -> dict[str, tuple[int, int]]:
    """By column: the exponent of the lowest limb and the number of limbs that hold all its values in all tables."""
    extremes: dict[str, list[float]] = {c: [] for c in columns}
    for df in dfs:
        wanted = [c for c in columns if c in df.columns]
        aggs = []
        for c in wanted:
            x = f"abs(CAST({quote(c)} AS DOUBLE))"
            finite = f"CASE WHEN {x} > 0 AND {x} < double('Infinity') THEN {x} END"
            aggs += [F.expr(f"min({finite})"), F.expr(f"max({finite})")]
        row = df.agg(*aggs).first() if aggs else []
        for i, c in enumerate(wanted):
            extremes[c] += [v for v in row[2 * i : 2 * i + 2] if v is not None]
    found = {}
    for c, values in extremes.items():
        low = max(-1074, math.frexp(min(values, default=1.0))[1] - 53)
        found[c] = low, max(1, -(-(math.frexp(max(values, default=1.0))[1] - low) // LIMB))
    return found


def sum_expression(column: str, low: int, limbs: int) -> str:
    """The SQL aggregate that sums a column whose values need these limbs; see :func:`places`."""
    x = f"CAST({quote(column)} AS DOUBLE)"

    def whole(j: int) -> str:
        """The value in units of limb j, cut towards zero; beyond 2^53 it is whole already."""
        q = f"({x} / {_double(low + LIMB * j)})"
        return f"(CASE WHEN abs({q}) < 9007199254740992D THEN CAST(CAST({q} AS BIGINT) AS DOUBLE) ELSE {q} END)"

    finite = f"abs({x}) < double('Infinity')"
    sums = []
    for j in range(limbs):
        above = f" - {whole(j + 1)} * {_BASE}D" if j + 1 < limbs else ""
        limb = f"CASE WHEN abs({x} / {_double(low + LIMB * j)}) >= {_ABOVE!r}D THEN 0D ELSE {whole(j)}{above} END"
        sums.append(f"sum(CASE WHEN {finite} THEN CAST(CAST({limb} AS BIGINT) AS DECIMAL(19,0)) END)")
    infinite = [f"count_if({x} = double('{sign}Infinity'))" for sign in ("", "-")]
    return (
        f"CASE WHEN count({x}) = 0 THEN CAST(NULL AS DOUBLE) "
        f"WHEN count_if(isnan({x})) > 0 OR ({infinite[0]} > 0 AND {infinite[1]} > 0) THEN double('NaN') "
        f"WHEN {infinite[0]} > 0 THEN double('Infinity') WHEN {infinite[1]} > 0 THEN double('-Infinity') "
        f"ELSE {_combined([f'coalesce({s}, 0)' for s in sums], low)} END"
    )


def _double(exponent: int) -> str:
    """2 to this power as a literal; beyond the range of doubles the quotients are 0."""
    return f"{2.0**exponent!r}D" if exponent < 1024 else "double('Infinity')"


def _combined(sums: list[str], low: int) -> str:
    """One double from the sums of the limbs, lowest first, that depends on the exact total only."""
    if len(sums) <= 2:
        high = f" + CAST({sums[1]} AS DECIMAL(38,0)) * {_BASE}BD" if len(sums) == 2 else ""
        return f"CAST(CAST({sums[0]} AS DECIMAL(38,0)){high} AS DOUBLE) * {_double(low)}"
    # Carries make every limb but the last a digit from 0 to 2^42 - 1, so equal totals have equal limbs.
    total = "CAST(s.c + t AS DECIMAL(38,0))"
    carry = f"CAST(({total} - pmod({total}, {_BASE}BD)) / {_BASE}BD AS DECIMAL(38,0))"
    digits = (
        f"aggregate(array({', '.join(f'CAST({s} AS DECIMAL(38,0))' for s in sums)}), "
        "named_struct('c', CAST(0 AS DECIMAL(38,0)), 'd', CAST(array() AS ARRAY<DOUBLE>)), "
        f"(s, t) -> named_struct('c', {carry}, 'd', concat(s.d, array(CAST(pmod({total}, {_BASE}BD) AS DOUBLE)))), "
        "s -> concat(slice(s.d, 1, size(s.d) - 1), "
        f"array(element_at(s.d, -1) + CAST(s.c AS DOUBLE) * {_BASE}D)))"
    )
    units = f"array({', '.join(_double(low + LIMB * j) for j in range(len(sums)))})"
    return f"aggregate(reverse(zip_with({digits}, {units}, (d, u) -> d * u)), 0D, (a, d) -> a + d)"
