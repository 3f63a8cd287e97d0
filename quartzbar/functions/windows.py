"""Window expressions as text, written once for every engine that speaks SQL windows.

``@20`` stands for the frame of the last twenty rows, ``@`` alone for the ordered partition. What a partition
is (symbol, or symbol and chunk) is filled in where the expression is used.
"""

from __future__ import annotations

import re
from collections.abc import Callable

_FRAME = re.compile(r"@(\d*)")


def frame(expression: str, keys: str, order: str = "idx") -> str:
    """The expression with its frames written out."""

    def over(m: re.Match) -> str:
        rows = f" ROWS BETWEEN {int(m[1]) - 1} PRECEDING AND CURRENT ROW" if m[1] else ""
        return f"OVER (PARTITION BY {keys} ORDER BY {order}{rows})"

    return _FRAME.sub(over, expression)


#: A call over a frame; its arguments hold no call with arguments of its own.
_CALL = re.compile(r"\w+\([^()]*(?:\([^()]*\)[^()]*)*\) @\d*")


def shared(layer: dict[str, str], keys: str, order: str = "idx") -> tuple[dict[str, str], dict[str, str]]:
    """(window columns, expressions over them) of a layer, each distinct window call once.

    An engine evaluates every window call it is given; means and deviations that several features use would
    be computed anew for each.
    """
    names: dict[str, str] = {}

    def name(m: re.Match) -> str:
        return names.setdefault(m[0], f"_w{len(names)}")

    rest = {n: _CALL.sub(name, e) for n, e in layer.items()}
    return {n: frame(call, keys, order) for call, n in names.items()}, rest


def ratio(a: str, b: str) -> str:
    """a / b, and 0 where b is 0 or either is missing."""
    return f"coalesce(({a}) / nullif({b}, 0), 0)"


def from_row(i: int, expression: str, otherwise: str = "0") -> str:
    """The expression from row i on (counted from 0); before, the warm-up value."""
    return f"CASE WHEN idx >= {i} THEN coalesce({expression}, {otherwise}) ELSE {otherwise} END"


def strict(n: int, expression: str, otherwise: str = "0") -> str:
    """The expression where its window of n rows is full."""
    return from_row(n - 1, expression, otherwise)


def spread(x: str, n: int) -> str:
    """Population standard deviation over n rows; 0 where it is not above rounding noise."""
    return f"CASE WHEN stddev_pop({x}) @{n} > 1e-12 * abs(avg({x}) @{n}) THEN stddev_pop({x}) @{n} ELSE 0 END"


def zscore(x: str, n: int) -> str:
    return strict(n, ratio(f"{x} - avg({x}) @{n}", spread(x, n)))


def to_mean(x: str, n: int) -> str:
    """x over its mean of n rows, less one; 0 where the mean is 0."""
    return strict(n, f"{x} / nullif(avg({x}) @{n}, 0) - 1")


def slope(x: str, n: int) -> str:
    """Least-squares slope over n rows, in units of the current value."""
    return strict(n, ratio(f"regr_slope({x}, idx) @{n}", x))


def rounded(names: list[str], digits: int = 6, of: Callable[[str], str] = lambda n: f"CAST({n} AS DOUBLE)") -> list[str]:
    """Select items that round doubles.

    A thousandth of the last digit is added first, so that values in the middle between two roundings, which
    prices often are, do not depend on the order of summation; the sum with 0 has no negative zero.
    """
    return [f"round({of(n)} + 1e-{digits + 3}, {digits}) + 0e0 AS {n}" for n in names]
