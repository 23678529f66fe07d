"""Text and number formatting as Column -> Column helpers.

All JVM-side built-ins; no Python per row.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def text_or_none(col: str | Column) -> Column:
    """How Python prints a value inside an f-string: NULL becomes 'None'."""
    return F.coalesce(_c(col).cast("string"), F.lit("None"))


def location(district: str | Column, state: str | Column) -> Column:
    """X3: "District, State"."""
    return F.concat(text_or_none(district), F.lit(", "), text_or_none(state))


def fixed1(col: str | Column) -> Column:
    """One-decimal text (``.1f`` / ``toFixed(1)``), rounded HALF_UP through
    a decimal cast; NULL stays NULL."""
    return _c(col).cast("decimal(38,1)").cast("string")


def round_half_up(col: str | Column, digits: int = 2) -> Column:
    """HALF_UP rounding on the decimal value."""
    return F.round(_c(col).cast("decimal(38,10)"), digits)


def truncate_label(col: str | Column, width: int = 15) -> Column:
    """A label longer than ``width`` is cut to ``width`` characters plus '…'."""
    c = _c(col)
    return F.when(F.char_length(c) > width,
                  F.concat(F.substring(c, 1, width), F.lit("…"))).otherwise(c)


def _scaled(c: Column, step: int) -> Column:
    """c / step done exactly: decimal(30,4) times the decimal reciprocal of a
    power of ten fits decimal(38,11), so the one rounding is in ``fixed1``."""
    digits = len(str(step)) - 1
    return c.cast("decimal(30,4)") * F.lit(Decimal(1).scaleb(-digits))


def thousands_cr(col: str | Column) -> Column:
    """Crore amounts in thousands of crore ("K Cr"), one decimal text."""
    return F.concat(fixed1(_scaled(_c(col), 1000)), F.lit("K Cr"))


# The mobile client's short-number ladder (amount in rupees).
COMPACT_STEPS = [(10_000_000, "Cr"), (100_000, "L"), (1_000, "T")]


def compact_amount(col: str | Column) -> Column:
    """X11: compact Indian number: >= 1e7 as Cr, >= 1e5 as L, >= 1e3 as T,
    one decimal; smaller values as whole numbers."""
    c = _c(col).cast("decimal(30,4)")
    expr = None
    for step, unit in COMPACT_STEPS:
        text = F.concat(fixed1(_scaled(c, step)), F.lit(unit))
        cond = F.abs(c) >= step
        expr = F.when(cond, text) if expr is None else expr.when(cond, text)
    return expr.otherwise(c.cast("decimal(38,0)").cast("string"))
