"""Text, label and time expressions of the dashboard as native Columns (no UDFs)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.schemas import (DEFAULT_GATEWAY_COLOR, DEFAULT_SYMBOL_COLOR, GATEWAY_COLORS,
                                SYMBOL_COLORS)

DASH = "—"       # em dash shown for missing text
ELLIPSIS = "…"
BULLETS = "••••"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c) -> Column:
    return F.when(F.trim(col_(c)) == "", F.lit(None)).otherwise(col_(c))


def fallback_text(*cols) -> Column:
    """First non-empty of the columns, else an em dash."""
    return F.coalesce(*[F.nullif(col_(c), F.lit("")) for c in cols], F.lit(DASH))


def status_bucket(c) -> Column:
    """Status pill colour green / amber / red / gray."""
    s = col_(c)
    return (F.when(s.isin("active", "confirmed", "settled", "verified"), "green")
            .when(s.isin("processing", "pending"), "amber")
            .when(s.isin("inactive", "failed", "error"), "red")
            .otherwise("gray"))


def type_label(c) -> Column:
    """Upper-cased type label."""
    return F.upper(col_(c))


def type_bucket(c) -> Column:
    """Type pill colour."""
    t = col_(c)
    return (F.when(t == "receive", "green").when(t == "send", "red")
            .when(t == "swap", "purple").when(t == "alloc", "amber").otherwise("gray"))


def short_address(c, limit: int = 16) -> Column:
    """Over ``limit`` chars -> first 8 + ellipsis + last 6."""
    s = col_(c)
    return F.when(F.length(s) > limit,
                  F.concat(F.left(s, F.lit(8)), F.lit(ELLIPSIS), F.right(s, F.lit(6)))).otherwise(s)


def clamp(c, lo, hi) -> Column:
    """Clamp into [lo, hi]."""
    return F.least(F.greatest(col_(c), F.lit(lo)), F.lit(hi))


def int_or_zero(c) -> Column:
    """The leading integer as JS ``parseInt`` reads it, or 0 (never raises under ANSI); beyond
    the int range its nearest end, whatever the number of digits."""
    lead = F.regexp_extract(col_(c).cast("string"), r"^\s*([+-]?\d+)", 1)
    low, high = F.lit(-(1 << 31)), F.lit((1 << 31) - 1)
    number = lead.try_cast("decimal(38,0)")         # null without a number, or with too many digits
    return (F.when(number.isNotNull(), F.least(F.greatest(number, low), high).cast("int"))
            .when(lead.startswith("-"), low).when(lead != "", high).otherwise(F.lit(0)))


def normalize_email(c) -> Column:
    """Lower + trim."""
    return F.lower(F.trim(col_(c)))


def full_name(first, last) -> Column:
    """``first last`` from trimmed parts; blank parts are skipped."""
    return F.concat_ws(" ", F.nullif(F.trim(col_(first)), F.lit("")), F.nullif(F.trim(col_(last)), F.lit("")))


def initials(first, last) -> Column:
    """Upper-case initials."""
    return F.upper(F.concat(F.left(F.trim(col_(first)), F.lit(1)),
                            F.left(F.trim(col_(last)), F.lit(1))))


def display_name(first, last, email) -> Column:
    """Full name, falling back to the e-mail when the name is empty."""
    return F.coalesce(F.nullif(full_name(first, last), F.lit("")), normalize_email(email))


def masked_account(last4) -> Column:
    """Bullets + last4."""
    return F.concat(F.lit(BULLETS), col_(last4))


def fee_label(fee, fixed_fee) -> Column:
    """``2.90%`` plus `` + $0.30`` when the fixed fee is positive (Q22)."""
    base = F.concat(F.format_number(F.round(col_(fee).cast("decimal(10,2)"), 2), 2), F.lit("%"))
    fixed = F.concat(F.lit(" + $"), F.format_number(F.round(col_(fixed_fee).cast("decimal(12,2)"), 2), 2))
    return F.when(F.coalesce(col_(fixed_fee), F.lit(0)) > 0, F.concat(base, fixed)).otherwise(base)


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


def symbol_color(c) -> Column:
    """Wallet symbol -> colour with default."""
    return F.coalesce(F.element_at(_map(SYMBOL_COLORS), col_(c)), F.lit(DEFAULT_SYMBOL_COLOR))


def gateway_color(c) -> Column:
    """Gateway name -> colour with default."""
    return F.coalesce(F.element_at(_map(GATEWAY_COLORS), col_(c)), F.lit(DEFAULT_GATEWAY_COLOR))


def capitalize(c) -> Column:
    """First letter upper-case, rest unchanged."""
    s = col_(c)
    return F.concat(F.upper(F.left(s, F.lit(1))), F.substring(s, 2, 1 << 30))


def first_element(c) -> Column:
    """First array element, null when empty (never raises)."""
    return F.get(col_(c), 0)


def percent_of(v, vmax) -> Column:
    """JS ``Math.round(v / max * 100)`` = ``floor(x + 0.5)``, as INT.

    Exact in whole cents: ``floor((200 * v + m) / (2 * m))``; no intermediate rounding, and
    ties round up as JS does (also for negatives)."""
    cents = [(col_(c).cast("decimal(28,2)") * 100).cast("decimal(30,0)") for c in (v, vmax)]
    sign = F.signum(cents[1]).cast("decimal(1,0)")
    value, top = (cents[0] * sign).cast("decimal(30,0)"), F.abs(cents[1])
    over = (value * 200 + top).cast("decimal(38,0)")
    return ((over - F.pmod(over, (top * 2).cast("decimal(38,0)"))) / (top * 2).cast("decimal(38,0)")).cast("int")


# date/time texts (session time zone is pinned to UTC).
def time_text(c) -> Column:
    return F.date_format(col_(c), "HH:mm:ss")


def datetime_text(c) -> Column:
    return F.date_format(col_(c), "yyyy-MM-dd HH:mm:ss")


def long_date_text(c) -> Column:
    return F.date_format(col_(c), "EEE, MMM d, yyyy")


def iso_text(c) -> Column:
    return F.date_format(col_(c), "yyyy-MM-dd'T'HH:mm:ss")
