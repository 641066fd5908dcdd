"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: str | Column) -> Column:
    """Neither null, NaN nor infinite."""
    c = col(c).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def safe_div(a: str | Column, b: str | Column) -> Column:
    """a / b; null where b is 0 or null."""
    return F.when(col(b) != 0, col(a) / col(b))


def asinh_scale(c: str | Column, scale: float = 1.0) -> Column:
    return F.asinh(col(c) / F.lit(float(scale)))


def log10_eps(c: str | Column, eps: float = 0.0) -> Column:
    return F.log10(col(c) + F.lit(float(eps)))


def clip(c: str | Column, low: float | None = None, high: float | None = None) -> Column:
    out = col(c)
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    return F.least(out, F.lit(float(high))) if high is not None else out


def signed_ratio(a: str | Column, b: str | Column, eps: float) -> Column:
    """a / b with the denominator kept at least eps away from 0, on its own side."""
    b = col(b)
    return col(a) / F.when(F.abs(b) >= eps, b).when(b < 0, -eps).otherwise(eps)


def cut(c: str | Column, edges: list[float], labels: list[str], right: bool = True, include_lowest: bool = False) -> Column:
    """Label of the fixed-edge bin; right-closed by default, and outside every bin null."""
    c = col(c)
    out = None
    for i, name in enumerate(labels):
        low, high = F.lit(float(edges[i])), F.lit(float(edges[i + 1]))
        inside = (c > low) & (c <= high) if right else (c >= low) & (c < high)
        if right and include_lowest and i == 0:
            inside = (c >= low) & (c <= high)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def segment(c: str | Column, bounds: list[float], labels: list[str]) -> Column:
    """Label of the first bound that c does not exceed; the last label beyond them."""
    out = None
    for b, name in zip(bounds, labels, strict=False):
        out = F.when(col(c) <= b, name) if out is None else out.when(col(c) <= b, name)
    return out.otherwise(labels[-1])


def quadrant(a: str | Column, b: str | Column, labels: tuple[str, str, str, str]) -> Column:
    """both, only a, only b, neither."""
    a, b = col(a), col(b)
    return F.when(a & b, labels[0]).when(a & ~b, labels[1]).when(~a & b, labels[2]).otherwise(labels[3])


def rule_class(rules: list[tuple[Column, str]], default: str) -> Column:
    """The class of the first rule that holds."""
    out = None
    for when, name in rules:
        out = F.when(when, name) if out is None else out.when(when, name)
    return out.otherwise(default) if out is not None else F.lit(default)


def parity(c: str | Column) -> Column:
    return F.when(col(c) % 2 == 0, "even").otherwise("odd")
