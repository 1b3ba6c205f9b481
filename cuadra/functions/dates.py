"""Dates and periods of statements, vouchers and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: months in Spanish, by number; September has two spellings.
MONTHS = {"ENERO": 1, "FEBRERO": 2, "MARZO": 3, "ABRIL": 4, "MAYO": 5, "JUNIO": 6, "JULIO": 7, "AGOSTO": 8, "SEPTIEMBRE": 9, "SETIEMBRE": 9, "OCTUBRE": 10, "NOVIEMBRE": 11, "DICIEMBRE": 12}
MONTH_WORDS = "|".join(MONTHS)


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def parse_date(text: Column, number: Column | None = None) -> Column:
    """dd/mm/yyyy: of spreadsheet serials from 20,000 to 80,000, texts of that form (not validated), and ISO dates; else null."""
    iso = r"^\d{4}-\d{2}-\d{2}"
    t = F.trim(text)
    parsed = F.when(t.rlike(r"^\d{2}/\d{2}/\d{4}$"), t).when(t.rlike(iso), F.concat_ws("/", F.substring(t, 9, 2), F.substring(t, 6, 2), F.substring(t, 1, 4)))
    if number is None:
        return parsed
    serial = F.date_format(F.date_add(F.lit("1899-12-30").cast("date"), F.floor(number).cast("int")), "dd/MM/yyyy")
    return F.when(number.between(20000, 80000), serial).when(number.isNull(), parsed)


def month_end(year: Column, month: Column) -> Column:
    """dd-mm-yyyy of a month's last day; null for no month."""
    ok = month.between(1, 12) & (year > 0)
    return F.when(ok, F.date_format(F.last_day(F.make_date(year, month, F.lit(1))), "dd-MM-yyyy"))


def month_number(word: Column) -> Column:
    pairs = [x for name, n in MONTHS.items() for x in (F.lit(name), F.lit(n))]
    return F.try_element_at(F.create_map(*pairs), F.upper(word))


def period_of_name(name: Column, today: Column) -> Column:
    """Month end of ``01-2025`` or ``Enero 2025`` in a name; of the month of ``today`` otherwise."""
    pair = r"(?<!\d)(\d{1,2})[-_/](\d{4})(?!\d)"
    word = rf"(?iu)({MONTH_WORDS})[^0-9]*(\d{{4}})"
    return F.coalesce(
        month_end(_found(name, pair, 2).cast("int"), _found(name, pair, 1).cast("int")),
        month_end(_found(name, word, 2).cast("int"), month_number(_found(name, word, 1))),
        month_end(F.year(today), F.month(today)),
    )


def period_of_dated_name(name: Column) -> Column:
    """Month end of ``2025-01-31`` or ``20250131`` in a name; else null."""
    tries = [r"(20\d{2})[-_/](\d{2})[-_/]\d{2}", r"(20\d{2})(\d{2})\d{2}"]
    return F.coalesce(*[month_end(_found(name, p, 1).cast("int"), _found(name, p, 2).cast("int")) for p in tries])


def period_to_date(period: Column) -> Column:
    """dd/mm/yyyy with dashes; the month end of m/yyyy or of a month's name and year; else as it is."""
    short, word = r"^(\d{1,2})[/-](\d{4})$", rf"(?iu)^({MONTH_WORDS})\s+(\d{{4}})$"
    t = F.trim(period)
    return F.coalesce(
        F.when(t.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.translate(t, "/", "-")),
        month_end(_found(t, short, 2).cast("int"), _found(t, short, 1).cast("int")),
        month_end(_found(t, word, 2).cast("int"), month_number(_found(t, word, 1))),
        t,
    )


def page_period(text: Column) -> Column:
    """A month's name and year on a page, else its first date; null without either."""
    phrase = _found(F.upper(text), rf"\b((?:{MONTH_WORDS})\s+\d{{4}})\b", 1)
    return F.coalesce(F.regexp_replace(phrase, r"\s+", " "), _found(text, r"\b(\d{2}/\d{2}/\d{4})\b", 1))


def block_date(text: Column) -> Column:
    """After ``F. Pres``, else after ``el día``, else the last date; empty without one."""
    date = r"([0-9]{2}/[0-9]{2}/[0-9]{4})"
    return F.coalesce(
        _found(text, rf"(?i)F\.\s*Pres\s*{date}", 1),
        _found(text, rf"(?iu)el\s+d[ií]a\s*{date}", 1),
        F.try_element_at(F.regexp_extract_all(text, F.lit(date), F.lit(1)), F.lit(-1)),
        F.lit(""),
    )


def age_seconds(modified: Column, now: Column) -> Column:
    return F.unix_timestamp(now) - F.unix_timestamp(modified)
