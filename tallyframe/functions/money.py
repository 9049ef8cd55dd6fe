"""Money and unit helpers as native Column expressions (no UDFs).

All amounts stay DECIMAL. Text formatting rounds half-up *before* formatting,
because ``format_number`` alone rounds half-even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.schemas import MONEY, QTY, SHARE, TOTAL


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c) -> Column:
    """Cast to DECIMAL(20,2) (half-up)."""
    return col_(c).cast(MONEY)


def total(c) -> Column:
    """Null-safe sum of money as DECIMAL(30,2): null or empty input gives 0 (A1, A2)."""
    return F.coalesce(F.sum(col_(c)), F.lit(0)).cast(TOTAL)


def usd_text(c) -> Column:
    """``$1,234.57``; null counts as 0."""
    x = F.coalesce(col_(c).cast(T_DEC_HIGH), F.lit(0).cast(T_DEC_HIGH))
    return F.concat(F.lit("$"), F.format_number(F.round(x, 2), 2))


def usd_text_signed(amount, type_col) -> Column:
    """X1 + X2: ``-`` for send, else ``+``, then the absolute USD text (Q18)."""
    sign = F.when(col_(type_col) == "send", F.lit("-")).otherwise(F.lit("+"))
    return F.concat(sign, usd_text(F.abs(col_(amount))))


def fixed(c, digits: int = 4) -> Column:
    """Fixed decimals, half-up, no grouping; null -> 0."""
    x = F.coalesce(col_(c).cast(QTY), F.lit(0).cast(QTY))
    return F.round(x, digits).cast(f"decimal(28,{digits})").cast("string")


def to_cents(c) -> Column:
    """Dollars -> integer cents, half away from zero (decimal, exact)."""
    return F.round(col_(c).cast(MONEY) * 100, 0).cast("bigint")


def from_cents(c) -> Column:
    """Integer cents -> DECIMAL(20,2) dollars (exact)."""
    return (col_(c).cast("decimal(20,0)") * F.lit(0.01).cast("decimal(3,2)")).cast(MONEY)


def share(amount, pct) -> Column:
    """X11: ``amount * pct / 100`` exactly, as DECIMAL(26,6).

    amount has scale 2, pct scale 2, the 0.01 factor scale 2: the exact product has
    scale 6, so no rounding happens and shares of one amount sum back exactly.
    """
    return (col_(amount).cast(MONEY) * col_(pct).cast("decimal(5,2)")
            * F.lit("0.01").cast("decimal(3,2)")).cast(SHARE)


def lamports_to_sol(c) -> Column:
    """Integer lamports -> SOL as DECIMAL(20,8) (half-up)."""
    return (col_(c).cast("decimal(20,0)") * F.lit("0.000000001").cast("decimal(10,9)")).cast(QTY)


# Hex wei -> ETH. ``conv`` works on 64-bit values only and raises past them, so the hex
# string is left-padded to 36 digits and converted in three 12-digit (48-bit) chunks,
# combined in DECIMAL(38,0). More than 31 significant digits (>= 2^124) could overflow
# DECIMAL(38,0) and is reported by ``wei_hex_ok`` before any arithmetic.
WEI_MAX_HEX_DIGITS = 31
_CHUNK = 12


def wei_digits(c) -> Column:
    """Hex digits of a ``0x`` wei string without prefix and leading zeros ('' for 0)."""
    return F.regexp_replace(F.lower(col_(c)), r"^0x0*", "")


def wei_hex_ok(c, digits=None) -> Column:
    """A ``0x`` hex string with at most 31 significant digits (fits DECIMAL(38,0))."""
    d = wei_digits(c) if digits is None else col_(digits)
    return (col_(c).isNotNull() & F.lower(col_(c)).rlike(r"^0x[0-9a-f]+$")
            & (F.length(d) <= WEI_MAX_HEX_DIGITS))


def wei_to_decimal(digits) -> Column:
    """Exact wei as DECIMAL(38,0) from validated significant hex digits."""
    padded = F.lpad(col_(digits), 3 * _CHUNK, "0")
    parts = [F.conv(F.substring(padded, 1 + i * _CHUNK, _CHUNK), 16, 10).cast("decimal(38,0)")
             for i in range(3)]
    two48 = F.lit(2 ** 48).cast("decimal(38,0)")
    two96 = F.lit(str(2 ** 96)).cast("decimal(38,0)")
    return (parts[0] * two96 + parts[1] * two48 + parts[2]).cast("decimal(38,0)")


def shift_point(digits: Column, scale: int) -> Column:
    """Insert a decimal point ``scale`` places from the right of a digit string."""
    n = F.length(digits)
    return (F.when(n <= scale, F.concat(F.lit("0."), F.lpad(digits, scale, "0")))
            .otherwise(F.concat(F.left(digits, n - scale), F.lit("."),
                                F.right(digits, F.lit(scale)))))


def with_wei_to_eth(df: DataFrame, hex_col: str, out_col: str, ok_col: str) -> DataFrame:
    """Hex wei -> ETH as DECIMAL(20,8), half-up at 1e-8 ETH (= 1e10 wei).

    Staged as successive columns so every step is computed once per row:
    significant digits -> validity (``ok_col``: at most 31 digits, checked before any
    arithmetic) -> exact DECIMAL(38,0) wei from three 48-bit ``conv`` chunks -> +5e9
    and drop ten digits of the text (half-up rounding) -> insert the point eight places
    from the right -> ``try_cast`` (null when too large for DECIMAL(20,8)).
    """
    d, t = f"_{out_col}_digits", f"_{out_col}_text"
    staged = (df.withColumn(d, wei_digits(hex_col))
              .withColumn(ok_col, wei_hex_ok(hex_col, d))
              .withColumn(t, F.when(F.col(ok_col), (wei_to_decimal(d) + F.lit(5_000_000_000).cast("decimal(38,0)"))
                                    .cast("decimal(38,0)").cast("string"))))
    units = F.when(F.length(t) > 10, F.left(F.col(t), F.length(t) - 10)).otherwise(F.lit("0"))
    return (staged.withColumn(t, units)
            .withColumn(out_col, F.when(F.col(ok_col), shift_point(F.col(t), 8).try_cast(QTY)))
            .drop(d, t))


T_DEC_HIGH = "decimal(38,2)"
