"""Text columns: accent folding, normalization, captures and label cleaning."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbers import once


#: Marks of Latin, Greek and Cyrillic letters, and runs of characters beyond them, among which others are.
COMMON_MARKS, BEYOND = re.compile("[\u0300-\u036f]+"), re.compile("[\u0370-\U0010ffff]+")


def plain(text: str) -> str:
    """Canonical decomposition without marks, of any script."""
    return BEYOND.sub(lambda m: "".join(c for c in m[0] if unicodedata.category(c) != "Mn"), COMMON_MARKS.sub("", unicodedata.normalize("NFD", text)))


def _collapsed(text: bytes) -> bytes:
    """Single spaces in a text as UTF-8: bytes are split at the same six characters as Java's ``\\s``."""
    return b" ".join(text.split())


def _plain_texts(texts: pa.Array, spaces: bool = True) -> pa.Array:
    """Texts of a batch without marks, with single spaces unless ``spaces`` are kept as they are; each distinct one is looked at once."""
    if not spaces and pc.all(pc.string_is_ascii(texts)).as_py() in (True, None):
        return texts
    distinct = texts.dictionary_encode()
    found = (t if t.isascii() else plain(t.decode()).encode() for t in distinct.dictionary.cast(pa.binary()).to_pylist())
    return pa.array(map(_collapsed, found) if spaces else found, pa.binary(), size=len(distinct.dictionary)).cast(texts.type).take(distinct.indices)


# The work is done in Python, so that plans hold a name where they held tables of all letters.
@F.arrow_udf(returnType=T.StringType())
def _stripped(texts: pa.Array) -> pa.Array:
    return _plain_texts(texts, spaces=False)


@F.arrow_udf(returnType=T.StringType())
def _single_spaced(texts: pa.Array) -> pa.Array:
    return _plain_texts(texts)


@F.arrow_udf(returnType=T.ArrayType(T.StringType()))
def _single_spaced_cells(cells: pa.Array) -> pa.Array:
    lists = pc.list_flatten(cells)
    return pa.ListArray.from_arrays(_offsets(cells), _plain_texts(lists), mask=cells.is_null() if cells.null_count else None)


def _offsets(cells: pa.Array) -> pa.Array:
    sizes = pc.fill_null(pc.list_value_length(cells), 0)
    return pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(sizes).cast(pa.int32())])


def strip_accents(text: Column) -> Column:
    """Canonical decomposition without marks, of any script. Null stays null."""
    return _stripped(text)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def norm_text(text: Column) -> Column:
    """No accents, single spaces, upper case; null counts as empty. For bank concepts and headers."""
    return F.upper(_single_spaced(F.coalesce(text, F.lit(""))))


def norm_cells(cells: Column) -> Column:
    """``norm_text`` of every text of an array."""
    return F.transform(_single_spaced_cells(cells), lambda c: F.upper(F.coalesce(c, F.lit(""))))


def norm_word(word: str) -> str:
    """``norm_text`` of a text that is known when the plan is made."""
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", plain(word)).strip(" ").upper()


def norm_upper(text: Column) -> Column:
    """No accents, upper case, spaces as they are. For settlement concepts."""
    return F.upper(strip_accents(F.coalesce(text, F.lit(""))))


def fold_header(text: Column) -> Column:
    """Lower case, Spanish letters to plain ones, single spaces."""
    return collapse(F.translate(F.lower(F.coalesce(text, F.lit(""))), "áéíóúñ", "aeioun"))


#: Fixed: a run of digits, dots and commas; an amount as Argentina writes it.
NUMBER = r"([0-9][0-9\.\,]*)"
AR_AMOUNT = r"([0-9]{1,3}(?:[.\s][0-9]{3})*,[0-9]{2})"


def last_number(text: Column) -> Column:
    """The last number of a line as text, null without one."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1)), F.lit(-1))


def ar_amounts(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(AR_AMOUNT), F.lit(1))


def first_int(text: Column) -> Column:
    return F.regexp_extract(text, r"\d+", 0).try_cast("int")


def clean_label(text: Column) -> Column:
    """Upper case letters, digits and ``/ % . -``, without the numbers."""
    kept = collapse(F.regexp_replace(F.upper(text), r"[^A-Z0-9/%\s.\-]", " "))
    return collapse(F.regexp_replace(kept, r"\b[0-9][0-9.,]*\b", ""))


def section_label(text: Column) -> Column:
    """Like ``clean_label``, with the numbers: what a line without an amount lends to the next ones."""
    return collapse(F.regexp_replace(F.upper(text), r"[^A-Z0-9/%\s.\-]", " "))


def after(text: Column, label: str, n: int, until: str | None = None) -> Column:
    """``n`` characters from the first place of ``label`` in any case, cut before ``until``; null where it isn't found."""
    at = F.instr(F.lower(text), label.lower())
    window = F.when(at > 0, F.substr(text, at, F.lit(n)))
    if until is None:
        return window
    cut = F.instr(F.lower(window), until.lower())
    return F.when(cut > 1, F.substr(window, F.lit(1), cut - 1)).otherwise(window)


#: Fixed: a date, a voucher's branch and number, and a number alone, within a file's name.
DATE = r"\b(\d{1,2}[-_/]\d{1,2}(?:[-_/]\d{2,4})?)\b"
VOUCHER, LONG_NUMBER = r"\b(\d{1,4}\s*[-_/]\s*\d{4,8})\b", r"\b(\d{8,14})\b"


def date_token(name: Column) -> Column:
    """A date within a file name, with dashes; null without one."""
    return _date_of(F.regexp_extract(name, DATE, 1))


def _date_of(found: Column) -> Column:
    return F.translate(F.nullif(found, F.lit("")), "_/", "--")


def voucher_token(name: Column) -> Column:
    """Branch and number of a voucher, or 8 to 14 digits; null without one."""
    return _voucher_of(F.regexp_extract(name, VOUCHER, 1), F.regexp_extract(name, LONG_NUMBER, 1))


def _voucher_of(pair: Column, number: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_replace(F.nullif(pair, F.lit("")), r"\s+", ""), "_/", "--"), F.nullif(number, F.lit("")))


#: Fixed: words for kinds of documents, which are no part of a provider's name.
DOCUMENT_WORDS = ["FAC", "FACT", "FACTURA", "NC", "NOTA", "CREDITO", "COMPROBANTE", "OK"]


def provider_key(name: Column) -> Column:
    """Provider within a file name, without its date and voucher; null where fewer than three characters are left."""
    kept = _provider_words(name, date_token(name), voucher_token(name))
    return F.when(F.length(kept) >= 3, kept)


def _provider_words(name: Column, date: Column, voucher: Column) -> Column:
    words = F.regexp_replace(F.upper(name), r"\b(?:" + "|".join(DOCUMENT_WORDS) + r")\b", " ")
    for token in (date, voucher):
        words = F.replace(words, F.coalesce(F.upper(token), F.lit("\u0000")), F.lit(" "))
    return collapse(F.regexp_replace(words, r"[^\p{L}\p{N}]+", " "))


def with_name_tokens(rows: DataFrame, name: Column) -> DataFrame:
    """``rows`` with _provider, _date and _voucher of a file name, as the functions of one name give them. Each expression is a
    column before it is named again, so that no name is searched twice."""
    c = F.col
    found = rows.withColumn("_name", name).withColumns({"_date": F.regexp_extract("_name", DATE, 1), "_voucher": F.regexp_extract("_name", VOUCHER, 1), "_number": F.regexp_extract("_name", LONG_NUMBER, 1)})
    found = found.withColumns({"_date": _date_of(c("_date")), "_voucher": _voucher_of(c("_voucher"), c("_number"))})
    found = found.withColumn("_provider", _provider_words(c("_name"), c("_date"), c("_voucher")))
    return found.withColumn("_provider", F.when(F.length("_provider") >= 3, c("_provider"))).drop("_name", "_number")


def detail_headers(raw: Column, notes: Column) -> Column:
    """Column titles after ``detalle:`` in the raw voucher, else in the notes, as an array."""
    found = lambda c: once(F.regexp_extract(c, r"(?i)\bdetalle\s*:\s*([^\n\r]+)", 1), lambda x: F.nullif(x, F.lit("")))
    parts = F.split(F.coalesce(found(raw), found(notes)), r"[,|;]+")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def expected_items(*fields: Column) -> Column:
    """N of ``cantidad de items: N``, from the first field that has one; the colon may be a dash or missing."""
    return F.coalesce(*[F.regexp_extract(f, r"(?i)cantidad\s+de\s+items\s*[:\-]?\s*(\d+)", 1).try_cast("int") for f in fields])


def truncate_concept(text: Column, n: int = 50) -> Column:
    one = collapse(text)
    return F.when(F.length(one) > n, F.rtrim(F.left(one, F.lit(n)))).otherwise(one)


def clean_control(text: Column) -> Column:
    return F.translate(text, "\t\r\n", "   ")


def norm_path(path: Column) -> Column:
    """A Windows path for comparison: no quotes, backslashes, no trailing ones, lower case."""
    bare = F.regexp_replace(F.trim(path), r"^[\"']+|[\"']+$", "")
    return F.lower(F.regexp_replace(F.regexp_replace(bare, r"[\\/]+", r"\\"), r"\\+$", ""))


def unquote(text: Column) -> Column:
    paired = F.regexp_replace(F.trim(text), r"^\"(.*)\"$|^'(.*)'$", "$1$2")
    return F.regexp_replace(paired, r"[\"']+$", "")


def split_pipe(line: Column) -> Column:
    """concept and total, at the first pipe; null without one."""
    parts = F.split(line, r"\|", 2)
    return F.when(F.contains(line, F.lit("|")), F.struct(F.trim(parts[0]).alias("concept"), F.trim(parts[1]).alias("total")))


def is_noise(line: Column) -> Column:
    """Blank lines, code fences, bold titles and rules."""
    t = F.trim(F.coalesce(line, F.lit("")))
    return (t == "") | t.startswith("```") | t.startswith("**") | (t == "---")


def safe_name(text: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", ""), F.lit("")), F.lit(default))
