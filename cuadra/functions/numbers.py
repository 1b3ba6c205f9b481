"""Amounts: three parsers, formatting, signs, and the control arithmetic.

Ledger amounts are decimals. Figures that are computed from doubles are rounded by their binary value, as ``cents`` says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
VAT = 0.21


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often that names it, and written once into the plan."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_nullable(text: Column) -> Column:
    """Digits, dots, commas and minus are kept; of two kinds of separators the last is the decimal one, a lone comma is, lone
    dots stay. Null for what is no number then."""
    plain = once(F.regexp_replace(text, r"[^\d,.\-]", ""), _plain)
    return plain.try_cast("double")


def _plain(s: Column) -> Column:
    dot, comma = F.instr(F.reverse(s), "."), F.instr(F.reverse(s), ",")
    return (
        F.when((dot > 0) & (comma > 0) & (comma < dot), F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when((dot > 0) & (comma > 0), F.replace(s, F.lit(","), F.lit("")))
        .when(comma > 0, F.replace(s, F.lit(","), F.lit(".")))
        .when(s != "", s)
    )


def parse_zero(text: Column) -> Column:
    return F.coalesce(parse_nullable(text), F.lit(0.0))


def parse_ar(text: Column, number: Column | None = None) -> Column:
    """As banks write them: brackets or any minus make it negative, a comma makes all dots thousands. 0 for what is no number.
    A cell that holds a number passes through."""
    t = F.trim(F.coalesce(text, F.lit("")))
    minus = F.contains(t, F.lit("-"))
    negative = (t.startswith("(") & t.endswith(")")) | minus
    # Each part is named once, since every name of it is worked out anew.
    s = F.when(F.contains(t, F.lit(",")), F.replace(F.regexp_replace(t, r"[^\d,]", ""), F.lit(","), F.lit("."))).otherwise(F.regexp_replace(t, r"[^\d.]", ""))
    # A minus that isn't in front makes it no number, as in "5-".
    bad = minus & t.rlike(r"\d[^\d]*-")
    value = F.when(~bad, s.try_cast("double"))
    parsed = F.coalesce(value * F.when(negative, -1.0).otherwise(1.0), F.lit(0.0)) + 0.0  # no negative zero
    return parsed if number is None else F.coalesce(number, parsed)


def format_ar(x: Column, places: int = 2) -> Column:
    """1.234,56"""
    return F.translate(F.format_number(x, places), ",.", ".,")


def money(x: Column) -> Column:
    return x.cast(MONEY)


def cents(x: Column, places: int = 2) -> Column:
    """A double rounded by its exact binary value, ties to even: 0.21 * 41092.50 is a little less than 8629.425, so 8629.42."""
    return F.replace(F.format_number(x.cast("double"), places), F.lit(",")).try_cast("double")


def clamp(x: Column, below: float = 0.005) -> Column:
    return F.when(F.abs(x) < below, F.lit(0)).otherwise(x)


def ledger_sign(category: Column, amount: Column) -> Column:
    """Card sales are positive, the residual keeps its sign, all else is negative."""
    return clamp(F.when(category == "TARJETA", F.abs(amount)).when(category == "OTROS", amount).otherwise(-F.abs(amount)))


def signed_amount(amount: Column, debit: Column, credit: Column) -> Column:
    return F.coalesce(amount, F.abs(F.coalesce(credit, F.lit(0))) - F.abs(F.coalesce(debit, F.lit(0))))


def vat_control(base: Column, vat: Column, rate: float = VAT) -> dict[str, Column]:
    """What VAT of ``base`` would be, how far ``vat`` is from it, and the base that would explain it."""
    theory = cents(base * rate)
    adjust = F.when(vat > 0, clamp(cents(vat / rate - base), 0.01)).otherwise(F.lit(0.0))
    theory2 = cents((base + adjust) * rate)
    return {
        "vat_theory": theory,
        "vat_diff": cents(vat - theory),
        "base_adjustment": adjust,
        "base_adjusted": cents(base + adjust),
        "vat_adjusted": theory2,
        "vat_diff_adjusted": cents(vat - theory2),
        "alert": F.abs(vat - theory) > 1,
    }


def deviates(a: Column, target: Column, limit: float) -> Column:
    """abs(a - target) / target is above the limit. A target that isn't positive never deviates."""
    return F.coalesce(F.try_divide(F.abs(a - target), target) > limit, F.lit(False))


def close_to(a: Column, target: Column, least: float = 1.0, share: float = 0.002) -> Column:
    return (a > 0) & (F.abs(a - target) <= F.greatest(F.lit(least), target * share))


def vat_or_theory(fees: Column, vat: Column, rate: float = VAT) -> Column:
    """VAT as read, or as it should be where fees are known and it is missing or more than 0.05 off.

    The theory is rounded in hundredths, as SQL's ``round`` of a double is, and not by its binary value: of 0.21 * 34582.50, a little
    below 7262.325 but 726232.5 in hundredths, that is 7262.33.
    """
    theory = F.round(fees * rate * 100) / 100
    return F.when((fees > 0) & ((vat <= 0) | (F.abs(vat - theory) > 0.05)), theory).otherwise(vat)


def implied_price(total: Column, quantity: Column, per_pack: Column, listed: Column, limit: float = 0.02) -> Column:
    """total / (quantity * per_pack), in place of a listed price that is missing or further off than ``limit``."""
    implied = F.try_divide(total, quantity * F.coalesce(per_pack, F.lit(1)))
    return F.when(implied.isNotNull() & (listed.isNull() | deviates(listed, implied, limit)), implied).otherwise(listed)
