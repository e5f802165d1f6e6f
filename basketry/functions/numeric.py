"""Numeric conventions shared by every operator.

Money and quantities are DECIMAL(18,4) going in; sums stay exact in decimal
and only the finished sum is turned into DOUBLE. Ratios divide two doubles so
the result is one IEEE operation (reproducible in any engine). Rounding is
done on DECIMAL(28,10) so it is half-away-from-zero, never banker's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,4)"
WIDE = "decimal(28,10)"


def money(c) -> Column:
    """Cast a raw numeric/text column to the canonical DECIMAL(18,4)."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast(MONEY)


def money_from_double(c) -> Column:
    """Source doubles carry at most 2 decimals: land them on DECIMAL(18,2) first."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("decimal(18,2)").cast(MONEY)


def dsum(c) -> Column:
    """Exact decimal sum, handed out as DOUBLE."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c).cast("double")


def zsum(c) -> Column:
    """Sum treating NULL as 0 (``SUM(COALESCE(x,0))``), exact, as DOUBLE."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(F.coalesce(c, F.lit(0).cast(MONEY))).cast("double")


def ratio(num, den) -> Column:
    """num / den on doubles; NULL when den is 0 or NULL (never raises)."""
    num = F.col(num) if isinstance(num, str) else num
    den = F.col(den) if isinstance(den, str) else den
    return F.try_divide(num.cast("double"), F.nullif(den.cast("double"), F.lit(0.0)))


def round_half_up(c, scale: int) -> Column:
    """Round a double half away from zero at ``scale`` decimals, return DOUBLE."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast(WIDE), scale).cast("double")
