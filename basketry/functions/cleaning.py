"""Column-level cleaning: dates, mobiles, walk-ins, payments, names.

All functions return ``Column`` expressions (JVM-side, codegen'd); none uses a
Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import MONEY

# ---------------------------------------------------------------------------
# Fixed values that must equal the source system's behaviour.
# Placeholder customer names that mark a bill as walk-in (upper-cased, trimmed).
WALK_IN_NAMES = [
    "CASH", "X", "MR", "PTF", "SUNDRY", "RETAIL", "CUSTOMER",
    "CASH CUSTOMER", "GENERAL", "GENERAL CUSTOMER",
    "WALK IN", "WALK-IN", "WALKIN", "RETAIL CUSTOMER",
]
WALK_IN_KEY = "WALK-IN"
WALK_IN_DISPLAY = "Walk-in / Retail"
# Export date text starts with day-month-year.
DATE_GUARD = r"^\d{2}-\d{2}-\d{4}"
# Ten-digit Indian mobile, optionally prefixed by 91 or 0 once digits are kept.
MOBILE_PATTERN = r"^(?:91|0)?([6-9][0-9]{9})$"
# Cell texts that mean no value in an export (as the source's CSV reader takes them).
NO_VALUE = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
            "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
# Journal-entry guard on bill payments.
PAYMENT_CAP = 1_000_000
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_date_prefix(c) -> Column:
    """Non-null text that starts with ``dd-MM-yyyy``."""
    c = _c(c)
    return c.isNotNull() & c.rlike(DATE_GUARD)


def export_date(c) -> Column:
    """The calendar day of an export datetime, NULL for garbage.

    The three export variants (``dd-MM-yyyyhh:mm AM``, with a space, 24 h)
    share the first ten characters, and only the day is used downstream.
    """
    c = _c(c)
    return F.when(has_date_prefix(c), F.try_to_date(F.substring(c, 1, 10), "dd-MM-yyyy"))


def export_timestamp(c) -> Column:
    """Full timestamp of an export datetime (12 h or 24 h), NULL if broken."""
    c = _c(c)
    spaced = F.when(F.substring(c, 11, 1) == " ", c).otherwise(
        F.concat(F.substring(c, 1, 10), F.lit(" "), F.substring(c, 11, 1 << 20)))
    spaced = F.trim(spaced)
    return F.when(
        has_date_prefix(c),
        F.coalesce(
            F.try_to_timestamp(spaced, F.lit("dd-MM-yyyy hh:mm a")),
            F.try_to_timestamp(spaced, F.lit("dd-MM-yyyy HH:mm")),
        ),
    )


def plain_date(c) -> Column:
    """``dd-MM-yyyy`` text to DATE, NULL when unparseable."""
    return F.try_to_date(_c(c), "dd-MM-yyyy")


def clean_mobile(c) -> Column:
    """P5: digits only, drop a 91/0 prefix, keep a valid 10-digit mobile else NULL."""
    digits = F.regexp_replace(F.coalesce(_c(c), F.lit("")), "[^0-9]", "")
    return F.nullif(F.regexp_extract(digits, MOBILE_PATTERN, 1), F.lit(""))


def is_walk_in(mobile_clean, name) -> Column:
    """No valid mobile, or a placeholder customer name."""
    placeholder = F.upper(F.trim(F.coalesce(_c(name), F.lit("")))).isin(WALK_IN_NAMES)
    return _c(mobile_clean).isNull() | placeholder


def z(c) -> Column:
    """COALESCE(x, 0) on the money type."""
    return F.coalesce(_c(c), F.lit(0).cast(MONEY))


def cash_amount(actual_cash="actual_cash", cash="cash_amount") -> Column:
    """Counted cash wins over the cash column, else 0."""
    return F.coalesce(_c(actual_cash), _c(cash), F.lit(0).cast(MONEY))


def upi_amount() -> Column:
    return z("google_pay_amount") + z("phonepe_amount") + z("paytm_amount")


def within_payment_cap(cap: int = PAYMENT_CAP) -> Column:
    """Drop journal entries (any of cash, card, net at or above the cap)."""
    return (
        (cash_amount() < F.lit(cap))
        & (z("card_amount") < F.lit(cap))
        & (z("net_total") < F.lit(cap))
    )


def blank_to_null(c) -> Column:
    """Trim, empty -> NULL."""
    return F.nullif(F.trim(_c(c)), F.lit(""))


def clean_cell(c) -> Column:
    """``2796.0`` -> ``2796``; texts that mean no value -> NULL; other text only trimmed."""
    t = F.trim(_c(c))
    # the pattern is only tried where it can match
    whole = F.when(t.contains(".0"), F.regexp_replace(t, r"^(-?\d+)\.0+$", "$1")).otherwise(t)
    return F.when(t.isin(NO_VALUE), F.lit(None).cast("string")).otherwise(whole)
