"""Bank statements to ledgers that close to zero."""

from __future__ import annotations

import functools
import json
import operator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import parse_date, period_of_name
from ..functions.numbers import MONEY, money, parse_ar, signed_amount, vat_control
from ..functions.text import clean_control, norm_cells, norm_text, norm_word
from ..operators.classify import BANK_CATEGORIES, bank_label, clamp_category, first_match_join, without_excluded
from ..operators.ledger import document_header, filled_categories, sums_by, with_contra
from ..sources.files import write_files
from ..sources.scratch import removed, written

#: Fixed: the built-in book of banks, in the order in which they are tried: their names, sheets, headers and columns.
BANKS = {
    "BNA": {
        "bank_name": "BANCO DE LA NACION ARGENTINA",
        "detect": {"sheet_name_contains": ["HOJA1 - TABLE", "HOJA1"], "headers_any": ["Fecha", "Comprobante", "Concepto", "Importe"]},
        "columns": {"date": "Fecha", "description": "Concepto", "amount": "Importe"},
    },
    "BPAT": {
        "bank_name": "BANCO PATAGONIA S.A.",
        "detect": {"sheet_name_contains": ["VERTVERT"], "headers_any": ["Fecha", "Descripción", "Débito", "Crédito"]},
        "columns": {"date": "Fecha", "description": "Descripción", "debit": "Débito", "credit": "Crédito"},
    },
}
#: Fixed: what a column is called where the book doesn't say.
TITLES = {"date": "Fecha", "description": "Concepto", "amount": "Importe", "debit": "Debito", "credit": "Credito"}


def read_banks(spark: SparkSession, path: str | None = None, beside: str | None = None, bundled: str | None = None) -> dict[str, dict]:
    """The banks of a JSON rule book, by key, in its order: those of ``path`` where that is given, else of the first of ``beside`` and
    ``bundled`` that exists, else the built-in ones. A file that isn't a rule book is an error."""
    for place in [path] if path else [beside, bundled]:
        if place and _exists(spark, place):
            try:
                banks = json.loads(spark.read.text(place, wholetext=True).first()[0])["banks"]  # one small file
                assert all(isinstance(b, dict) for b in banks.values())
            except (ValueError, KeyError, TypeError, AttributeError, AssertionError) as e:
                raise ValueError(f"{place} is no rule book: {e!r}") from e
            return banks
    return BANKS


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def bank_names(banks: dict[str, dict]) -> dict[str, str]:
    return {key: b.get("bank_name") or key for key, b in banks.items()}


#: Fixed: what the first rows of a statement say, by which the built-in banks are known.
SAID = ["MOVIMIENTOS DE CUENTA", "DEBITO", "CREDITO", "DESCRIPCION", "BANCO NACION", "ULTIMOS MOVIMIENTOS", "COMPROBANTE", "CONCEPTO", "IMPORTE"]
#: Unknown concepts that a control sheet lists.
UNKNOWN = 20


def has_all(cells: Column, titles: list[str]) -> Column:
    """Every title is within the row: in a cell, or across cells that are joined by a bar."""
    return _says_all(F.array_join(norm_cells(cells), " | "), titles)


def _says_all(row: Column, titles: list[str]) -> Column:
    out = F.lit(True)
    for title in titles:
        out = out & F.contains(row, F.lit(norm_word(title)))
    return out


def column_of(header: Column, title: str) -> Column:
    """1-based place of the first cell that has the title; null without one."""
    return F.nullif(F.array_position(F.transform(norm_cells(header), lambda c: F.contains(c, F.lit(norm_word(title)))), F.lit(True)), F.lit(0)).cast("int")


def _any_of(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(norm_word(w)))
    return out


def detect_bank(cells: DataFrame, banks: dict[str, dict] = BANKS) -> DataFrame:
    """bank and header_row of each file: the first bank of the book whose sheet name and titles it has; else by the file's name, then
    by what its first 80 rows say, which know the built-in banks only. Both are null where nothing fits."""
    # Each row is normalized once, before its many tests; names of files and sheets once for each sheet.
    normal = cells.select("file", "sheet_name", "row_no", norm_cells(F.col("cells")).alias("_cells"))
    normal = normal.select("file", "sheet_name", "row_no", F.array_join("_cells", " | ").alias("_row"), F.array_join(F.slice("_cells", 1, 8), " | ").alias("_said"))
    row = F.col("_row")
    first_two = [[(b.get("columns") or {})[r] for r in TITLES if (b.get("columns") or {}).get(r)][:2] for b in banks.values()]
    titles = [(b.get("detect") or {}).get("headers_any") or [] for b in banks.values()]
    tests = [F.max(_says_all(row, t)).alias(f"_titles_{k}") for k, t in enumerate(titles)]
    tests += [F.max((F.col("row_no") <= 80) & F.contains("_said", F.lit(w))).alias(f"_says_{k}") for k, w in enumerate(SAID)]
    tests += [F.min(F.when(_says_all(row, t), F.col("row_no"))).alias(f"_head_{k}") for k, t in enumerate(first_two)]
    sheets = normal.groupBy("file", "sheet_name").agg(*tests)
    sheets = sheets.withColumns({"_sheet": norm_text(F.col("sheet_name")), "_name": norm_text(F.col("file"))})
    sheet, name = F.col("_sheet"), F.col("_name")
    by_rules = []
    for k, (bank, b) in enumerate(banks.items()):
        names = (b.get("detect") or {}).get("sheet_name_contains") or []
        by_rules.append(F.when(F.max((_any_of(sheet, names) if names else F.lit(True)) & F.col(f"_titles_{k}")), F.lit(bank)))
    by_name = F.when(_any_of(name, ["BPAT", "PATAGONIA"]), "BPAT").when(_any_of(name, ["BNA", "NACION"]) | F.contains(name, F.lit("NAC ")), "BNA")
    says = lambda w: F.max(f"_says_{SAID.index(w)}")
    named = lambda *words: F.max(functools.reduce(operator.and_, [F.contains(sheet, F.lit(w)) for w in words]))
    by_text = (
        F.when(named("VERTVERT"), "BPAT").when(named("HOJA1", "TABLE"), "BNA")
        .when(says("MOVIMIENTOS DE CUENTA") | (says("DEBITO") & says("CREDITO") & says("DESCRIPCION")), "BPAT")
        .when(says("BANCO NACION") | says("ULTIMOS MOVIMIENTOS") | (says("COMPROBANTE") & says("CONCEPTO") & says("IMPORTE")), "BNA")
    )
    header = [F.min(f"_head_{k}").alias(f"head_{k}") for k in range(len(banks))]
    found = sheets.groupBy("file").agg(F.coalesce(*by_rules, F.first(by_name, ignorenulls=True), by_text).alias("bank"), *header)
    return found.select("file", "bank", _by_bank({b: F.col(f"head_{k}") for k, b in enumerate(banks)}).alias("header_row"))


def statement_rows(cells: DataFrame, banks: dict[str, dict] = BANKS) -> DataFrame:
    """file, bank, row_no, date, concept and amount of the rows below each file's header that have a date and a concept. Rows of
    sheets are read three times here, so they are written once before."""
    return rows_below(kept := written(cells, "cells")[0], detect_bank(kept, banks), banks)


def rows_below(cells: DataFrame, found: DataFrame, banks: dict[str, dict] = BANKS) -> DataFrame:
    """``statement_rows`` of cells whose banks and headers have been ``found``."""
    found = found.where("bank is not null and header_row is not null")
    heads = cells.join(found, "file").where("row_no = header_row")
    place = lambda role: _by_bank({k: column_of(F.col("cells"), (b.get("columns") or {}).get(role) or TITLES[role]) for k, b in banks.items()})
    heads = heads.select("file", "bank", "header_row", *[place(r).alias(f"at_{r}") for r in TITLES])
    # One narrow row per file: joined by file, broadcast where it is small.
    rows = cells.join(heads, "file").where("row_no > header_row")
    text = lambda r: F.try_element_at("cells", F.col(f"at_{r}"))
    number = lambda r: F.try_element_at("nums", F.col(f"at_{r}"))
    value = lambda r: F.when(F.trim(text(r)) != "", parse_ar(text(r), number(r)))
    rows = rows.select("file", "bank", "row_no", parse_date(text("date"), number("date")).alias("date"), F.trim(text("description")).alias("concept"), signed_amount(F.when(text("amount").isNotNull(), F.coalesce(value("amount"), F.lit(0.0))), value("debit"), value("credit")).alias("amount"))
    return rows.where("date is not null and concept <> ''")


def _by_bank(choices: dict[str, Column]) -> Column:
    case = F
    for bank, c in choices.items():
        case = case.when(F.col("bank") == bank, c)
    return case


def classified(rows: DataFrame, rules: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Statement rows that aren't excluded, with their category; null where no rule matches."""
    kept = without_excluded(rows, "concept", exclusions, "bank")
    return first_match_join(kept, "concept", rules, "bank")


def ledger(rows: DataFrame) -> DataFrame:
    """file, ord, category, amount: every category in order; the base is adjusted to the VAT, and BANCO balances all."""
    known = rows.where("category is not null and abs(amount) >= 0.005").withColumn("category", clamp_category(F.col("category"), BANK_CATEGORIES))
    totals = sums_by(known, ["file", "category"])
    base = -F.coalesce(F.max(F.when(F.col("category") == "GASTO", F.col("amount"))), F.lit(0)).cast("double")
    vat = -F.coalesce(F.max(F.when(F.col("category") == "IVA_CREDITO", F.col("amount"))), F.lit(0)).cast("double")
    adjust = totals.groupBy("file").agg(base.alias("base"), vat.alias("vat"))
    adjust = adjust.select("file", F.lit(BANK_CATEGORIES[2]).alias("category"), money(-vat_control(F.col("base"), F.col("vat"))["base_adjustment"]).alias("amount"))
    closed = with_contra(totals.unionByName(adjust), ["file"], "BANCO")
    return filled_categories(closed, ["file"], BANK_CATEGORIES)


def ledger_lines(entries: DataFrame, found: DataFrame, banks: dict[str, dict] = BANKS) -> DataFrame:
    """``entries`` with BANCO named by the bank of its file."""
    named = entries.join(found.select("file", bank_label(_by_bank({b: F.lit(n) for b, n in bank_names(banks).items()})).alias("_label")), "file", "left")
    return named.withColumn("category", F.when(F.col("category") == "BANCO", F.coalesce("_label", "category")).otherwise(F.col("category"))).drop("_label")


def header_lines(found: DataFrame, today: Column, banks: dict[str, dict] = BANKS) -> DataFrame:
    """file and header: bank, subject, month end of the file's name (of today without one) and the concept of the ledger."""
    name = _by_bank({b: F.lit(n) for b, n in bank_names(banks).items()})
    return found.select("file", document_header("GB", name, F.lit("GASTOS BANCARIOS"), period_of_name(F.col("file"), today), name).alias("header"))


#: Fixed: how the category of the adjustment is written in controls and logs.
ADJUSTMENT = "NETO_GRAVADO_POR_AJUSTE_IVA"
CONTROL_TITLES = "LINEA\tCONCEPTO\tCATEGORIA\tCANTIDAD\tIMPORTE_TOTAL"
SUMMARY_TITLES = "RESUMEN_POR_CATEGORIA\t\t\t\t\nLINEA\tCATEGORIA\tIMPORTE_TOTAL\t\t"
VAT_TITLES = "IVA_21_CONTROL\t\t\t\t\nBASE_GASTO_21\tIVA_TEORICO_21\tIVA_CREDITO_REAL\tDIFERENCIA\tAJUSTE_NETO_GRAVADO\tBASE_AJUSTADA\tIVA_TEORICO_AJUSTADO\tDIF_POST_AJUSTE"


def _two(x: Column) -> Column:
    return F.format_string("%.2f", F.coalesce(x.cast("double"), F.lit(0.0)))


def _joined(rows: DataFrame, order: Column, line: Column, name: str) -> DataFrame:
    """A file's lines in order, as one text; a file has a line for each of its concepts or categories."""
    lines = F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l"))))
    return rows.groupBy("file").agg(F.concat(F.array_join(F.transform(lines, lambda x: x["l"]), "\n"), F.lit("\n")).alias(name))


def _code(category: Column) -> Column:
    return F.when(category == BANK_CATEGORIES[2], ADJUSTMENT).otherwise(category)


def control_texts(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """file and text of each file's control sheet: concepts by absolute sum, the adjustment among them, then the categories of its
    ledger, the control of its VAT, and an alert where that is more than 1 off. ``rows`` are classified, ``entries`` their ledger."""
    c = controls(rows)
    made = entries.where((F.col("category") == BANK_CATEGORIES[2]) & (F.abs("amount") >= 0.01)).select("file", F.lit(BANK_CATEGORIES[2]).alias("concept"), "category", F.lit(1).cast("long").alias("n"), F.col("amount").cast(MONEY).alias("amount"), F.lit(2**31 - 1).alias("first_row"))
    concepts = c["concepts"].select("file", "concept", "category", "n", "amount", F.col("first_row").cast("int").alias("first_row")).unionByName(made)
    concepts = concepts.withColumn("o", F.row_number().over(Window.partitionBy("file").orderBy(F.abs("amount").desc(), "first_row", "concept")))
    first = _joined(concepts, F.col("o"), F.concat_ws("\t", F.col("o").cast("string"), F.trim(clean_control(F.col("concept"))), _code(F.col("category")), F.col("n").cast("string"), _two(F.col("amount"))), "concepts")
    second = _joined(entries, F.col("ord"), F.concat(F.concat_ws("\t", (F.col("ord") + 1).cast("string"), _code(F.col("category")), _two(F.col("amount"))), F.lit("\t\t")), "summary")
    figures = ["base", "vat_theory", "vat", "vat_diff", "base_adjustment", "base_adjusted", "vat_adjusted", "vat_diff_adjusted"]
    alert = F.when(F.col("alert"), F.concat(F.lit("ALERTA_IVA_21\tDIFERENCIA detectada: "), _two(F.col("vat_diff")), F.lit(". Se sugiere ajuste neto gravado: "), _two(F.col("base_adjustment")), F.lit("\t\t\t\n")))
    third = c["vat"].select("file", F.concat(F.concat_ws("\t", *[_two(F.col(f)) for f in figures]), F.lit("\n"), F.coalesce(alert, F.lit(""))).alias("vat"))
    none = F.lit("\t".join(["0.00"] * len(figures)) + "\n")
    whole = second.join(first, "file", "left").join(third, "file", "left")
    return whole.select("file", F.concat(F.lit(CONTROL_TITLES + "\n"), F.coalesce("concepts", F.lit("")), F.lit("\n" + SUMMARY_TITLES + "\n"), "summary", F.lit("\n" + VAT_TITLES + "\n"), F.coalesce("vat", none)).alias("text"))


def log_texts(cells: DataFrame, statement: DataFrame, rows: DataFrame, entries: DataFrame) -> DataFrame:
    """file and text of each file's log: its bank and sheet, rows analyzed (excluded ones too) and matched, the sum of each category,
    and the concepts that no rule knows, the most frequent first."""
    c = controls(rows)
    sheets = cells.groupBy("file").agg(F.min_by("sheet_name", "row_no").alias("sheet"))
    counts = statement.groupBy("file", "bank").agg(F.count("*").alias("analyzed")).join(c["counts"].select("file", "matched"), "file", "left")
    totals = _joined(entries, F.col("ord"), F.concat(F.lit("total_"), _code(F.col("category")), F.lit("="), _two(F.col("amount"))), "totals")
    unknown = c["unknown"].withColumn("o", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("n"), "first_row", "concept"))).where(F.col("o") <= UNKNOWN)
    listed = _joined(unknown, F.col("o"), F.concat(F.lit("- "), F.col("concept"), F.lit(" | cnt="), F.col("n").cast("string")), "unknown")
    whole = counts.join(sheets, "file").join(totals, "file", "left").join(listed, "file", "left")
    line = lambda name, value: F.concat(F.lit(f"{name}="), F.coalesce(value.cast("string"), F.lit("")), F.lit("\n"))
    parts = [line("archivo", F.col("file")), line("banco", F.col("bank")), line("sheet", F.col("sheet")), line("rows_analyzed", F.col("analyzed")), line("rows_matched", F.coalesce("matched", F.lit(0))), F.coalesce("totals", F.lit(""))]
    return whole.select("file", F.concat(*parts, F.coalesce(F.concat(F.lit("no_clasificados_top20:\n"), "unknown"), F.lit(""))).alias("text"))


def write_statements(cells: DataFrame, rules: DataFrame, exclusions: DataFrame, today: Column, folders: str | list[str], banks: dict[str, dict] = BANKS) -> str:
    """Three files for each statement, in the first folder that can be written to: the ledger (.txt), its log (.log) and the control
    of its concepts (_control_conceptos.xls, which is text). Returns the folder."""
    spark = cells.sparkSession
    cells, zero = written(cells, "cells")
    found, four = written(detect_bank(cells, banks), "banks")
    statement, one = written(rows_below(cells, found, banks), "statement")
    rows, two = written(classified(statement, rules, exclusions), "classified")
    entries, three = written(ledger(rows), "entries")
    lines = ledger_lines(entries, found, banks)
    text = _joined(lines, F.col("ord"), F.concat("category", F.lit("|"), _two(F.col("amount"))), "lines")
    text = header_lines(found, today, banks).join(text, "file").select("file", F.concat("header", "lines").alias("text"))
    named = lambda df, end: df.select(F.concat(F.regexp_replace("file", r"\.[^.]*$", ""), F.lit(end)).alias("name"), F.col("text").alias("content"))
    documents = named(text, ".txt").union(named(control_texts(rows, entries), "_control_conceptos.xls")).union(named(log_texts(cells, statement, rows, entries), ".log"))
    try:
        return write_files(documents, folders)
    finally:
        removed(spark, zero, one, two, three, four)


def control_sheets(rows: DataFrame) -> DataFrame:
    """Rows of every file's control sheet: section (CONCEPTOS, IVA, ANALISIS, SIN REGLA), ord, concept, category, n and amount."""
    c = controls(rows)
    order = lambda *by: F.row_number().over(Window.partitionBy("file").orderBy(*by))
    none = lambda kind: F.lit(None).cast(kind)
    section = lambda df, name, ord_, concept, category, n, amount: df.select("file", F.lit(name).alias("section"), ord_.cast("int").alias("ord"), concept.alias("concept"), category.alias("category"), n.cast("long").alias("n"), amount.cast(MONEY).alias("amount"))
    concepts = section(c["concepts"], "CONCEPTOS", order(F.abs("amount").desc(), "first_row", "concept"), F.col("concept"), F.col("category"), F.col("n"), F.col("amount"))
    figures = ["base", "vat", "vat_theory", "vat_diff", "base_adjustment", "base_adjusted", "vat_adjusted", "vat_diff_adjusted"]
    vat = c["vat"].select("file", F.posexplode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("x")) for n in figures])).alias("k", "f"))
    vat = section(vat, "IVA", F.col("k") + 1, F.col("f.name"), none("string"), none("long"), F.col("f.x"))
    counts = c["counts"].select("file", F.posexplode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("x")) for n in ("analyzed", "matched")])).alias("k", "f"))
    counts = section(counts, "ANALISIS", F.col("k") + 1, F.col("f.name"), none("string"), F.col("f.x"), none("double"))
    unknown = c["unknown"].withColumn("o", order(F.desc("n"), "first_row", "concept")).where(F.col("o") <= UNKNOWN)
    return concepts.union(vat).union(counts).union(section(unknown, "SIN REGLA", F.col("o"), F.col("concept"), none("string"), F.col("n"), none("double")))


def controls(rows: DataFrame) -> dict[str, DataFrame]:
    """Concepts by absolute sum, the VAT control of each file, rows analyzed and matched, and unknown concepts by number."""
    known = rows.where("category is not null and abs(amount) >= 0.005")
    concepts = known.groupBy("file", "concept", "category").agg(F.count("*").alias("n"), F.sum(money(F.col("amount"))).cast(MONEY).alias("amount"), F.min("row_no").alias("first_row")).orderBy("file", F.abs("amount").desc(), "first_row")
    sums = known.groupBy("file").agg(*[F.coalesce(-F.sum(F.when(F.col("category") == c, money(F.col("amount")))), F.lit(0)).cast("double").alias(n) for c, n in (("GASTO", "base"), ("IVA_CREDITO", "vat"))])
    vat = sums.select("*", *[c.alias(n) for n, c in vat_control(F.col("base"), F.col("vat")).items()])
    counts = rows.groupBy("file").agg(F.count("*").alias("analyzed"), F.count_if(F.col("category").isNotNull() & (F.abs("amount") >= 0.005)).alias("matched"))
    unknown = rows.where("category is null").groupBy("file", "concept").agg(F.count("*").alias("n"), F.min("row_no").alias("first_row")).orderBy(F.desc("n"), "first_row")
    return {"concepts": concepts, "vat": vat, "counts": counts, "unknown": unknown}
