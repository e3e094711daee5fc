"""Pieces of oracle SQL shared by several queries."""

from __future__ import annotations

from premia.functions.numeric import (
    TAIL_BOTTOM,
    TAIL_LIMIT,
    TAIL_ROOT,
    TAIL_SWITCH,
    TAIL_TOP,
    expected_maximum,
)


def _horner(x: str, coefficients: tuple[float, ...]) -> str:
    text = f"{coefficients[0]!r}::DOUBLE"
    for coefficient in coefficients[1:]:
        text = f"({text} * {x} + {coefficient!r}::DOUBLE)"
    return text


def cdf(x: str) -> str:
    """Normal distribution function of a SQL expression."""

    a = f"abs({x})"
    e = f"exp(-0.5e0 * {a} * {a})"
    near = f"{e} * {_horner(a, TAIL_TOP)} / {_horner(a, TAIL_BOTTOM)}"
    chain = f"({a} + 0.65e0)"
    for step in (4, 3, 2, 1):
        chain = f"({a} + {step}.0e0 / {chain})"
    tail = (
        f"CASE WHEN {a} < {TAIL_SWITCH!r}::DOUBLE THEN {near} "
        f"WHEN {a} <= {TAIL_LIMIT}::DOUBLE THEN {e} / ({chain} * {TAIL_ROOT}::DOUBLE) ELSE 0.0e0 END"
    )
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} > 0 THEN 1.0e0 - ({tail}) ELSE {tail} END"


def maxima(limit: int) -> str:
    """VALUES rows (trials, expected maximum)."""

    return ", ".join(f"({n}, {expected_maximum(n)!r}::DOUBLE)" for n in range(1, limit + 1))
