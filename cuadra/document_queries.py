"""Queries that run whole plans, and functions on texts, over documents made from the driver's tables, each with SQL.

The documents (answers, sheets, pages, names) are written from the rows of a table as a client would write them, with faults among
them; the SQL computes what must come out from the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions import dates, jsontext, numbers, text
from .operators import classify, frames, ingest, ledger
from .plans import agent, bank, invoice, invoice_json, settlement
from .queries import query, read
from .sources import documents
from .sources.files import read_files, write_files
from .sources.scratch import in_parts, removed, shared_folder, written
from .sources.sheets import sheet_rows


def _picked(n, *choices):
    """One of the literals, by a number from 0; null where the choice is None."""
    return F.element_at(F.array(*[F.lit(c) for c in choices]), (F.pmod(n, F.lit(len(choices))) + 1).cast("int"))


def _sql_picked(n: str, *choices: str | None) -> str:
    quoted = ["NULL" if c is None else "'" + c.replace("'", "''") + "'" for c in choices]
    return f"(list_value({', '.join(quoted)})[CAST(({n}) % {len(choices)} AS INT) + 1])"


def _ar(amount):
    return numbers.format_ar(amount)


# Invoices: one document per order, its lines on two pages; line 1 is repeated on the second one.

_INVOICE_NOTE = "Detalle: Cant., Artículo, Desc, Dto %, Desc. dto, Precio, Total\ncantidad de items: "


def _answers(spark, sf_dir) -> DataFrame:
    """doc, page_no and text. Both pages of a document are written within its row, so they are dealt by ``doc`` when they come out."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("doc"), F.struct(F.col("l_linenumber").alias("k"), "l_partkey", "l_quantity", "l_extendedprice").alias("line"))
    lines = lines.groupBy("doc").agg(F.collect_list("line").alias("lines"))
    fields = lambda x, price: F.struct(F.concat(F.lit("P"), x["l_partkey"]).alias("Codigo_Articulo"), F.lit("x").alias("Descripcion"), x["l_quantity"].cast("int").cast("string").alias("Cantidad"), price.alias("Importe_Neto"), price.alias("Total"), F.lit("raro").alias("Otro campo"))
    row = lambda x: F.struct(x["k"].alias("k"), numbers.once(_ar(x["l_extendedprice"]), lambda price: F.to_json(fields(x, price))).alias("row"))
    docs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("doc"), F.col("o_orderkey").alias("key"), "o_custkey", F.col("o_totalprice").alias("total")).join(lines, "doc", "left")
    docs = docs.withColumn("rows", F.sort_array(F.transform(F.coalesce("lines", F.array().cast(docs.schema["lines"].dataType)), row)))
    docs = docs.withColumns({"shown": _ar(F.col("total")), "n": F.size("rows").cast("string")})

    def text(first: bool) -> Column:
        some = lambda x: x["k"] <= 3 if first else F.coalesce((x["k"] > 3) | (x["k"] == 1), F.lit(True))
        rows = F.array_join(F.transform(F.filter("rows", some), lambda x: x["row"]), ",")
        head = F.to_json(F.struct(F.when(F.lit(first) & (F.col("key") % 2 == 0), "").otherwise(F.concat(F.lit("ACME "), "o_custkey")).alias("Nombre"), F.lit("7" if first else "8").alias("CAE")))
        totals = F.to_json(F.struct((F.lit(" ") if first else F.col("shown")).alias("Total"), F.lit("5,00" if first else "").alias("IVA 21%")))
        note = F.to_json(F.struct((F.concat(F.lit(_INVOICE_NOTE), "n") if first else F.lit("")).alias("comprobante_raw")))
        whole = F.concat(F.lit('﻿respuesta: {"CAB":'), head, F.lit(',"ROWS":["malo",'), rows, F.lit('],"TOTALES":'), totals, F.lit(',"meta":'), note, F.lit(",} fin"))
        return whole if first else F.when(F.col("key") % 7 == 0, F.lit("sin datos")).otherwise(whole)

    return docs.select("doc", F.inline(F.array(*[F.struct(F.lit(k).alias("page_no"), text(k == 1).alias("text")) for k in (1, 2)])))


@query("""
WITH l AS (
  SELECT DISTINCT l_orderkey, l_partkey, CAST(l_quantity AS INT) AS q, CAST(l_extendedprice AS DECIMAL(18,2)) AS p FROM lineitem WHERE l_linenumber <= 3 OR l_orderkey % 7 <> 0
), s AS (SELECT l_orderkey, count(*) AS n, CAST(sum(p) AS DOUBLE) AS t FROM l GROUP BY 1
), e AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1
), r AS (
  SELECT o_orderkey, o_custkey, coalesce(s.n, 0) AS n, s.t, coalesce(e.n, 0) AS expected, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS target
  FROM orders LEFT JOIN s ON s.l_orderkey = o_orderkey LEFT JOIN e ON e.l_orderkey = o_orderkey
)
SELECT CAST(o_orderkey AS VARCHAR) AS doc, CASE WHEN o_orderkey % 14 = 0 THEN '' ELSE 'ACME ' || o_custkey END AS supplier, '7' AS cae, '5,00' AS vat, n AS n_rows, t AS row_total, target, CAST(expected AS INT) AS expected,
  coalesce(abs(t - target) / target > 0.03, false) AS flagged, n > 0 AND n >= expected AND NOT coalesce(abs(t - target) / target > 0.03, false) AS good,
  CASE WHEN n = 0 THEN '' ELSE 'Cantidad,Codigo_Articulo,Descripcion,% Dto1,% Dto2,Importe_Neto,Total' END AS columns
FROM r
""")
def invoice_plan(spark, sf_dir):
    docs = invoice.documents(_answers(spark, sf_dir))
    heads = [F.col("CAB")["Nombre"].alias("supplier"), F.col("CAB")["CAE"].alias("cae"), F.col("TOTALES")["IVA 21%"].alias("vat"), F.array_join(invoice.column_order(docs), ",").alias("columns")]
    return invoice.checked_within(docs, *heads).select("doc", "supplier", "cae", "vat", "n_rows", "row_total", "target", "expected", "flagged", "good", "columns")


@query("""
SELECT CAST(l_orderkey AS VARCHAR) AS doc, 'P' || l_partkey AS code, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS quantity, CAST(p AS DOUBLE) AS total, count(*) AS n
FROM (SELECT DISTINCT l_orderkey, l_partkey, l_quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS p FROM lineitem WHERE l_linenumber <= 3 OR l_orderkey % 7 <> 0) GROUP BY ALL
""")
def invoice_detail_rows(spark, sf_dir):
    rows = invoice.detail_rows(invoice.documents(_answers(spark, sf_dir)))
    return rows.groupBy("doc", F.col("Codigo_Articulo").alias("code"), F.col("Cantidad").alias("quantity"), numbers.parse_nullable(F.col("Total")).alias("total")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, CAST(CASE l_linenumber % 3 WHEN 0 THEN 500.0 WHEN 1 THEN 500.0 ELSE 505.0 END AS DOUBLE) AS price FROM lineitem WHERE l_quantity >= 1")
def implied_unit_price(spark, sf_dir):
    """Total / (quantity * pack) in place of a price that is missing or more than 2 % off."""
    q, kind = F.col("l_quantity").cast("int"), F.col("l_linenumber") % 3
    listed = F.when(kind == 1, F.lit(700.0)).when(kind == 2, F.lit(505.0))
    price = numbers.implied_price((q * 2500).cast("double"), q.cast("double"), F.lit(5), listed)
    return read(spark, sf_dir, "lineitem").where("l_quantity >= 1").select("l_orderkey", "l_linenumber", price.alias("price"))


# Bank statements: one file per user group, a title row above the header, then a row for each event.

_CONCEPTS = {"signup": "Comisión  mantenimiento", "purchase": "TRANSFER RECIBIDA", "error": "IVA ALICUOTA 21%", "click": "GRAVAMEN LEY 25413 S/DEB", "view": "PAGO SERVICIO LUZ"}
_FILE_SQL = "'extracto ' || lpad(CAST(user_id % 12 + 1 AS VARCHAR), 2, '0') || '-2024 ' || user_id || '.xls'"


def _cells(spark, sf_dir) -> DataFrame:
    events = read(spark, sf_dir, "events")
    file = F.concat(F.lit("extracto "), F.lpad((F.col("user_id") % 12 + 1).cast("string"), 2, "0"), F.lit("-2024 "), "user_id", F.lit(".xls"))
    nacion = F.col("user_id") % 2 == 0
    sheet = F.when(nacion, "Hoja1 - Table 1").otherwise("vertvert")
    files = events.select("user_id").distinct()
    title = files.select(file.alias("file"), sheet.alias("sheet_name"), F.lit(-2).alias("row_no"), F.array(F.lit("Movimientos")).alias("cells"), F.array(F.lit(None).cast("double")).alias("nums"))
    header = F.when(nacion, F.array(*map(F.lit, ["Fecha", "Comprobante", "CONCEPTO", "Importe $"]))).otherwise(F.array(*map(F.lit, ["Fecha", "Descripción", "Débito", "Crédito"])))
    header = files.select(file.alias("file"), sheet.alias("sheet_name"), F.lit(-1).alias("row_no"), header.alias("cells"), F.array_repeat(F.lit(None).cast("double"), 4).alias("nums"))
    concept = F.element_at(F.create_map(*[F.lit(x) for kv in _CONCEPTS.items() for x in kv]), F.col("event_type"))
    amount = F.col("value").cast("decimal(18,2)")
    serial = F.datediff(F.to_date("ts"), F.lit("1899-12-30").cast("date")).cast("double")
    written = F.col("event_id") % 3
    day = F.when(written == 0, F.date_format("ts", "dd/MM/yyyy")).when(written == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm")).otherwise(serial.cast("int").cast("string"))
    first = F.when(F.col("event_id") % 11 == 0, "").otherwise(day)
    number = F.when((written == 2) & (F.col("event_id") % 11 != 0), serial)
    plain = F.lit(None).cast("double")
    cells = F.when(nacion, F.array(first, F.lit("1"), concept, F.concat(F.lit("-"), _ar(amount)))).otherwise(F.array(first, concept, _ar(amount), F.lit("")))
    nums = F.when(nacion, F.array(number, plain, plain, plain)).otherwise(F.array(number, plain, plain, plain))
    rows = events.select(file.alias("file"), sheet.alias("sheet_name"), F.col("event_id").cast("int").alias("row_no"), cells.alias("cells"), nums.alias("nums"))
    return title.union(header).union(rows)


def _statement(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Classified rows of the statements, and their banks; both are written, as several branches use them."""
    rules, out = classify.read_rules(spark)
    cells, _ = written(_cells(spark, sf_dir), "cells")
    banks, _ = written(bank.detect_bank(cells), "banks")
    return written(bank.classified(bank.rows_below(cells, banks), rules, out), "classified")[0], banks


_BANK_SQL = f"""
WITH t AS (SELECT DISTINCT user_id FROM events),
e AS (SELECT *, CAST(value AS DECIMAL(18,2)) AS v FROM events WHERE event_id % 11 <> 0),
known AS (SELECT user_id, event_type, v, event_id FROM e WHERE event_type IN ('signup', 'error', 'click') AND v >= 0.005),
s AS (SELECT user_id, coalesce(sum(v) FILTER (event_type = 'signup'), 0) AS base, coalesce(sum(v) FILTER (event_type = 'error'), 0) AS vat, coalesce(sum(v) FILTER (event_type = 'click'), 0) AS idc FROM known GROUP BY 1),
a AS (SELECT *, {_FILE_SQL} AS file, CASE WHEN vat > 0 AND abs(round(CAST(vat AS DOUBLE) / 0.21 - CAST(base AS DOUBLE), 2)) >= 0.01 THEN round(CAST(vat AS DOUBLE) / 0.21 - CAST(base AS DOUBLE), 2) ELSE 0 END AS adjust FROM s)
"""


@query(_BANK_SQL + """
SELECT file, CAST(ord AS INT) AS ord, category, CAST(amount AS DOUBLE) AS amount FROM (
  SELECT file, unnest(range(9)) AS ord,
    unnest([CASE WHEN user_id % 2 = 0 THEN 'BANCO NACION' ELSE 'BANCO PATAGONIA' END, 'GASTO', 'NETO GRAVADO POR AJUSTE IVA', 'IDC_A_COMPUTAR', 'IVA_CREDITO', 'RET_IVA', 'RET_IIBB', 'RET_GAN', 'OTROS']) AS category,
    unnest([base + vat + idc + CAST(adjust AS DECIMAL(18,2)), -base, -CAST(adjust AS DECIMAL(18,2)), -idc, -vat, 0, 0, 0, 0]) AS amount FROM a)
""")
def bank_plan(spark, sf_dir):
    rows, banks = _statement(spark, sf_dir)
    lines = bank.ledger_lines(bank.ledger(rows), banks)
    return lines.select("file", "ord", "category", F.col("amount").cast("double").alias("amount"))


@query(_BANK_SQL + f"""
, concepts AS (SELECT user_id, event_type, count(*) AS n, -sum(v) AS amount, min(event_id) AS first FROM known GROUP BY 1, 2)
SELECT {_FILE_SQL} AS file, 'CONCEPTOS' AS section, CAST(row_number() OVER (PARTITION BY user_id ORDER BY abs(amount) DESC, first) AS INT) AS ord,
  CASE event_type WHEN 'signup' THEN 'Comisión  mantenimiento' WHEN 'error' THEN 'IVA ALICUOTA 21%' ELSE 'GRAVAMEN LEY 25413 S/DEB' END AS concept, n, CAST(amount AS DOUBLE) AS amount FROM concepts
UNION ALL SELECT {_FILE_SQL}, 'ANALISIS', 1, 'analyzed', count(*), NULL FROM e WHERE event_type <> 'purchase' GROUP BY user_id
UNION ALL SELECT {_FILE_SQL}, 'ANALISIS', 2, 'matched', count(*) FILTER (event_type <> 'view' AND v >= 0.005), NULL FROM e WHERE event_type <> 'purchase' GROUP BY user_id
UNION ALL SELECT {_FILE_SQL}, 'SIN REGLA', 1, 'PAGO SERVICIO LUZ', count(*), NULL FROM e WHERE event_type = 'view' GROUP BY user_id
UNION ALL SELECT file, 'IVA', CAST(unnest([1, 2, 5]) AS INT), unnest(['base', 'vat', 'base_adjustment']), NULL, unnest([CAST(base AS DOUBLE), CAST(vat AS DOUBLE), adjust]) FROM a
""")
def bank_control_sheets(spark, sf_dir):
    sheet = bank.control_sheets(_statement(spark, sf_dir)[0]).where("section <> 'IVA' or ord in (1, 2, 5)")
    return sheet.select("file", "section", "ord", "concept", "n", F.col("amount").cast("double").alias("amount"))


@query(f"""
SELECT {_FILE_SQL} AS file, CASE WHEN user_id % 2 = 0 THEN 'BNA' ELSE 'BPAT' END AS bank, -1 AS header_row,
  concat_ws(chr(10), b, 'GASTOS BANCARIOS', p, rtrim(left('GB ' || p || ' ' || b, 50)), 'CONCEPTO|IMPORTE', '') AS header
FROM (SELECT DISTINCT user_id, CASE WHEN user_id % 2 = 0 THEN 'BANCO DE LA NACION ARGENTINA' ELSE 'BANCO PATAGONIA S.A.' END AS b, strftime(last_day(make_date(2024, CAST(user_id % 12 + 1 AS INT), 1)), '%d-%m-%Y') AS p FROM events)
""")
def bank_headers(spark, sf_dir):
    banks, _ = written(bank.detect_bank(_cells(spark, sf_dir)), "banks")
    return banks.join(bank.header_lines(banks, F.lit("2020-01-01").cast("date")), "file")


@query(f"SELECT {_FILE_SQL} AS file, CAST(event_id AS INT) AS row_no, strftime(ts, '%d/%m/%Y') AS date, -CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS amount FROM events WHERE event_id % 11 <> 0")
def bank_statement_rows(spark, sf_dir):
    rows = bank.statement_rows(_cells(spark, sf_dir))
    return rows.select("file", "row_no", "date", "amount")


def _workbook(pdf):
    """One row with the workbook of a file's rows: blank ones after the last, more beyond them, and a second sheet."""
    import pandas as pd

    from .sources.sheets import xlsx

    rows = [(k, [n if n == n and n is not None else c for c, n in zip(r.cells, r.nums, strict=True)]) for k, r in enumerate(pdf.sort_values("row_no").itertuples(), 1)]
    beyond = [(rows[-1][0] + 200, rows[-1][1])]
    return pd.DataFrame({"name": [pdf.file[0] + "x"], "content": [xlsx({pdf.sheet_name[0]: rows + beyond, "Notas": rows})]})


@query(f"""
WITH w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)
SELECT {_FILE_SQL} || 'x' AS file, CAST(k + 2 AS INT) AS row_no, strftime(ts, '%d/%m/%Y') AS date, -CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS amount FROM w WHERE event_id % 11 <> 0""")
def bank_workbooks(spark, sf_dir):
    """Statements written as a workbook each, with a blank tail and a second sheet, and read again through the window of the source."""
    books = _cells(spark, sf_dir).groupBy("file").applyInPandas(_workbook, "name string, content binary")
    at = write_files(books, shared_folder(spark, "workbooks"))
    return bank.statement_rows(sheet_rows(spark, at, window=True)).select("file", "row_no", "date", "amount")


@query(_BANK_SQL + f"""
, amounts AS (SELECT file, user_id, unnest(range(9)) AS ord, unnest(['BANCO', 'GASTO', 'NETO_GRAVADO_POR_AJUSTE_IVA', 'IDC_A_COMPUTAR', 'IVA_CREDITO', 'RET_IVA', 'RET_IIBB', 'RET_GAN', 'OTROS']) AS category,
  unnest([base + vat + idc + CAST(adjust AS DECIMAL(18,2)), -base, -CAST(adjust AS DECIMAL(18,2)), -idc, -vat, 0, 0, 0, 0]) AS amount FROM a),
totals AS (SELECT file, user_id, string_agg('total_' || category || '=' || printf('%.2f', CAST(amount AS DOUBLE)) || chr(10), '' ORDER BY ord) AS t FROM amounts GROUP BY 1, 2),
n AS (SELECT user_id, count(*) AS analyzed, count(*) FILTER (event_type IN ('signup', 'error', 'click') AND v >= 0.005) AS matched, count(*) FILTER (event_type = 'view') AS unknown FROM e GROUP BY 1)
SELECT replace(file, '.xls', '.log') AS name, concat('archivo=', file, chr(10), 'banco=', CASE WHEN user_id % 2 = 0 THEN 'BNA' ELSE 'BPAT' END, chr(10), 'sheet=', CASE WHEN user_id % 2 = 0 THEN 'Hoja1 - Table 1' ELSE 'vertvert' END, chr(10),
  'rows_analyzed=', analyzed, chr(10), 'rows_matched=', matched, chr(10), t, CASE WHEN unknown > 0 THEN concat('no_clasificados_top20:', chr(10), '- PAGO SERVICIO LUZ | cnt=', unknown, chr(10)) ELSE '' END) AS text
FROM totals JOIN n USING (user_id)
""")
def bank_files(spark, sf_dir):
    """The three files of every statement are written; the logs are read again."""
    rules, out = classify.read_rules(spark)
    at = bank.write_statements(_cells(spark, sf_dir), rules, out, F.lit("2020-01-01").cast("date"), shared_folder(spark, "statements"))
    return read_files(spark, at, ".log").select("name", F.col("content").cast("string").alias("text"))


# Card settlements: a page for each order; amounts are whole cents, so that both sides agree to the cent.

_CENTS_SQL = "SELECT o_custkey, o_orderkey, t, t * 18 // 1000 AS f, t * 18 // 1000 * 21 // 100 AS i FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS t FROM orders WHERE o_totalprice > 100)"


def _settlement_pages(spark, sf_dir, first: str, tax: str = " 21,00%") -> DataFrame:
    o = read(spark, sf_dir, "orders").where("o_totalprice > 100").withColumn("t", F.round(F.col("o_totalprice") * 100).cast("long")).withColumn("f", F.expr("t * 18 div 1000")).withColumn("i", F.expr("f * 21 div 100"))
    write = lambda c: _ar(c.cast("decimal(20,2)") / 100)
    lines = [F.lit(first), F.concat(F.lit("Ventas c/descuento contado+  $ "), write(F.col("t"))), F.concat(F.lit("ARANCEL- $ "), write(F.col("f"))), F.concat(F.lit(f"IVA CRED.FISC.COMERCIO S/ARANC{tax} $ "), write(F.col("i"))), F.concat(F.lit("IMPORTE NETO DE PAGOS $ "), write(F.col("t") - F.col("f") - F.col("i")))]
    page = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return o.select(F.col("o_custkey").cast("string").alias("doc"), F.lit("d.pdf").alias("file"), page.alias("page_no"), F.concat_ws("\n", *lines).alias("text"))


@query(f"""
WITH c AS ({_CENTS_SQL}), s AS (SELECT o_custkey, sum(t) AS t, sum(f) AS f, sum(i) AS i FROM c GROUP BY 1)
SELECT CAST(o_custkey AS VARCHAR) AS doc, CAST(unnest([1, 2, 3, 4]) AS INT) AS ord, unnest(['VENTAS C/DESCUENTO CONTADO', 'ARANCEL', 'IVA CRED.FISC.COMERCIO S/ARANC 21,00%', 'IMPORTE NETO DE PAGOS']) AS category,
  unnest([CAST(t AS DOUBLE) / 100, -CAST(f AS DOUBLE) / 100, -CAST(i AS DOUBLE) / 100, -CAST(t - f - i AS DOUBLE) / 100]) AS amount FROM s
""")
def settlement_plan(spark, sf_dir):
    none = spark.createDataFrame([], "doc string, text string")
    return settlement.ledger(_settlement_pages(spark, sf_dir, "BANCO NACION"), none).select("doc", "ord", "category", F.col("amount").cast("double").alias("amount"))


@query(f"""
WITH c AS ({_CENTS_SQL})
SELECT CAST(o_custkey AS VARCHAR) AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS block, CAST(t AS DOUBLE) / 100 AS sales, CAST(f + i AS DOUBLE) / 100 AS charges, CAST(0 AS DOUBLE) AS gap FROM c
UNION ALL SELECT CAST(o_custkey AS VARCHAR), NULL, CAST(sum(t) AS DOUBLE) / 100, CAST(sum(f + i) AS DOUBLE) / 100, 0 FROM c GROUP BY o_custkey
""")
def settlement_daily_sheet(spark, sf_dir):
    pages = _settlement_pages(spark, sf_dir, "BCO DE LA NACION ARGENTINA")
    sheet = settlement.daily_sheet(pages, settlement.document_facts(pages))
    return sheet.select("doc", "block", F.col(f"`{classify.SALES}`").cast("double").alias("sales"), F.col("charges").cast("double").alias("charges"), F.col("check").cast("double").alias("gap"))


@query(f"""
WITH c AS ({_CENTS_SQL}), s AS (SELECT o_custkey, sum(t) AS t, sum(f) AS f, sum(i) AS i, sum(t - f - i) AS n FROM c GROUP BY 1),
v AS (SELECT *, CASE WHEN f > 0 AND (i <= 0 OR abs(CAST(i AS DOUBLE) / 100 - round(CAST(f AS DOUBLE) / 100 * 0.21, 2)) > 0.05) THEN CAST(round(round(CAST(f AS DOUBLE) / 100 * 0.21, 2) * 100) AS BIGINT) ELSE i END AS w FROM s)
SELECT CAST(o_custkey AS VARCHAR) AS doc, CAST(unnest(range(8)) AS INT) AS ord, unnest(['TARJETA', 'BANCO', 'GASTO', 'IVA_CREDITO', 'RET_IVA', 'RET_IIBB', 'RET_GAN', 'OTROS']) AS category,
  unnest([CAST(t AS DOUBLE) / 100, -CAST(n AS DOUBLE) / 100, -CAST(f AS DOUBLE) / 100, -CAST(w AS DOUBLE) / 100, 0, -5.0, 0, CASE WHEN abs(t - n - f - w - 500) < 1 THEN 0 ELSE -CAST(t - n - f - w - 500 AS DOUBLE) / 100 END]) AS amount FROM v
""")
def settlement_by_page_sums(spark, sf_dir):
    pages = _settlement_pages(spark, sf_dir, "resumen", "")
    answers = pages.select("doc").distinct().select("doc", F.lit("CONCEPTO|TOTAL\n```\nTARJETA|1\nRET IIBB SIRTAC|3,00\nSIRTAC|5,00\n").alias("text"))
    return settlement.ledger(pages, answers).select("doc", "ord", "category", F.col("amount").cast("double").alias("amount"))


@query(f"SELECT CAST(o_custkey AS VARCHAR) AS doc, count(*) AS blocks, CAST(sum(t) AS BIGINT) AS cents FROM (SELECT DISTINCT o_custkey, t, f, i FROM ({_CENTS_SQL})) GROUP BY 1")
def settlement_anchored_blocks(spark, sf_dir):
    pages = _settlement_pages(spark, sf_dir, "BANCO NACION")
    twice = pages.unionByName(pages.withColumn("file", F.lit("e.pdf")))  # equal blocks of a document count once
    blocks = settlement.anchored_blocks(twice)
    return blocks.where(F.col("label") == classify.SALES).groupBy("doc").agg(F.countDistinct("block_key").alias("blocks"), F.sum(F.round(F.col("amount") * 100).cast("long")).alias("cents"))


_CARDS = ["TARJETA DE DEBITO MAESTRO", "TARJETA  DE  CREDITO", "American Express", "una visa", "CABAL", "sin marca"]


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS doc, CASE c_custkey % 3 WHEN 0 THEN 'BANCO DEL SUR' WHEN 1 THEN 'BANCO DE LA NACION ARGENTINA' ELSE 'BANCO PATAGONIA S.A.' END AS bank,
  strftime(last_day(make_date(2025, CAST(c_custkey % 12 + 1 AS INT), 1)), '%d-%m-%Y') AS period, c_custkey % 3 = 1 AS nacion, c_custkey % 3 = 2 AS patagonia FROM customer
""")
def settlement_facts(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    first = _picked(k, "Entidad Pagadora\nBANCO DEL SUR\n", "pago de BCO DE LA NACION ARGENTINA\n", "BANCO PATAGONIA\n")
    month = F.element_at(F.array(*[F.lit(m) for m in dates.MONTHS if m != "SETIEMBRE"]), (k % 12 + 1).cast("int"))
    body = F.concat(first, _picked(k, *_CARDS), F.lit("\nPeriodo "), F.lower(month), F.lit("   2025\n01/02/2020"))
    pages = c.select(k.cast("string").alias("doc"), F.lit("x.pdf").alias("file"), F.lit(1).alias("page_no"), body.alias("text"))
    facts = settlement.document_facts(pages)
    return facts.select("doc", F.col("bank_name").alias("bank"), dates.period_to_date(F.col("period")).alias("period"), "nacion", "patagonia")


@query(f"""
WITH x AS (SELECT c_custkey, {_sql_picked('c_custkey', 'TARJETA AMEX', 'TARJETA VISA', 'TARJETA CABAL', 'TARJETA MASTERCARD', 'TARJETA NARANJA', None)} AS card,
  CASE c_custkey % 2 WHEN 0 THEN 'BANCO DE LA NACION ARGENTINA' ELSE 'BANCO PATAGONIA S.A.' END AS bank, strftime(last_day(make_date(2024, CAST(c_custkey % 12 + 1 AS INT), 1)), '%d-%m-%Y') AS p FROM customer)
SELECT CAST(c_custkey AS VARCHAR) AS doc, concat_ws(chr(10), bank, coalesce(card, ''), p, rtrim(left(trim(regexp_replace(concat_ws(' ', 'LIQ', p, coalesce(card, ''), CASE WHEN c_custkey % 2 = 0 THEN 'BANCO NACION' ELSE bank END), '\\s+', ' ', 'g')), 50)), 'CONCEPTO|IMPORTE', '') AS header FROM x
""")
def settlement_headers(spark, sf_dir):
    k = F.col("c_custkey")
    card = _picked(k, "con AMEX", "VISA", "cabal", "MasterCard", "de naranja", "sin")
    text_ = F.concat(_picked(k, "BANCO NACION\n", "BANCO PATAGONIA\n"), card, F.lit("\n"), F.element_at(F.array(*[F.lit(m) for m in dates.MONTHS if m != "SEPTIEMBRE"]), (k % 12 + 1).cast("int")), F.lit(" 2024"))
    pages = read(spark, sf_dir, "customer").select(k.cast("string").alias("doc"), F.lit("x.pdf").alias("file"), F.lit(1).alias("page_no"), text_.alias("text"))
    return settlement.header_lines(settlement.document_facts(pages))


@query("""
WITH c AS (SELECT o_custkey, t, d, v FROM (SELECT o_custkey, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS t, CAST(round(o_totalprice * 100) AS BIGINT) // 20 AS d, CAST(round(o_totalprice * 100) AS BIGINT) // 100 AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders WHERE o_totalprice > 100) WHERE r = 1)
SELECT CAST(o_custkey AS VARCHAR) AS doc, unnest(['TOTAL PRESENTADO', 'ARANCEL TJ.C', 'IVA 21', 'SALDO']) AS category, unnest([CAST(t AS DOUBLE) / 100, -CAST(d AS DOUBLE) / 100, -CAST(v AS DOUBLE) / 100, -CAST(t - d AS DOUBLE) / 100]) AS amount FROM c
""")
def patagonia_plan(spark, sf_dir):
    o = read(spark, sf_dir, "orders").where("o_totalprice > 100").withColumn("r", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).where("r = 1")
    t = F.round(F.col("o_totalprice") * 100).cast("long")
    o = o.withColumn("t", t).withColumn("d", F.expr("t div 20")).withColumn("v", F.expr("t div 100"))
    write = lambda c: _ar(c.cast("decimal(20,2)") / 100)
    lines = ["BANCO PATAGONIA", F.concat(F.lit("Total presentado $ "), write(F.col("t"))), F.concat(F.lit("Total descuento $ "), write(F.col("d"))), F.concat(F.lit("Saldo $ "), write(F.col("t") - F.col("d"))), "Desglose de descuentos", F.concat(F.lit("Arancel Tj.C $ "), write(F.col("d"))), "IVA 21", F.concat(F.lit("% 21,00 $ "), write(F.col("v"))), "Dolares U$S 9,00", "____", "Otra cosa $ 1,00"]
    pages = o.select(F.col("o_custkey").cast("string").alias("doc"), F.lit("p.pdf").alias("file"), F.lit(1).alias("page_no"), F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines]).alias("text"))
    return settlement.ledger(pages, spark.createDataFrame([], "doc string, text string")).select("doc", "category", F.col("amount").cast("double").alias("amount"))


# Functions on texts, over names and notes made from customers' and events' numbers, faulty ones among them.

def _key():
    return F.col("c_custkey")


def _customers(spark, sf_dir, *columns) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", *columns)


@query(f"""
WITH x AS (SELECT c_custkey, c_custkey % 28 + 1 AS d, c_custkey % 12 + 1 AS m FROM customer)
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN d || '-' || m WHEN 1 THEN d || '-' || m || '-24' END AS date,
  CASE c_custkey % 4 WHEN 0 THEN '0-' || (700000 + c_custkey) WHEN 1 THEN '0000-' || (700000 + c_custkey) WHEN 2 THEN '' || (3000000000 + c_custkey) END AS voucher,
  CASE c_custkey % 4 WHEN 3 THEN 'PROVEEDOR' ELSE 'ACME SA' END AS provider FROM x
""")
def file_name_tokens(spark, sf_dir):
    d, m = (_key() % 28 + 1).cast("string"), (_key() % 12 + 1).cast("string")
    number = (700000 + _key()).cast("string")
    name = F.when(_key() % 4 == 0, F.concat(F.lit("Factura ACME S.A "), d, F.lit("-"), m, F.lit(" 0-"), number)).when(_key() % 4 == 1, F.concat(F.lit("acme sa nota CREDITO "), d, F.lit("-"), m, F.lit("-24 0000-"), number)).when(_key() % 4 == 2, F.concat(F.lit("ACME SA comprobante "), (3000000000 + _key()).cast("string"))).otherwise(F.lit("proveedor OK"))
    return _customers(spark, sf_dir, text.date_token(name).alias("date"), text.voucher_token(name).alias("voucher"), F.replace(text.provider_key(name), F.lit("ACME S A"), F.lit("ACME SA")).alias("provider"))


@query("""
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN strftime(last_day(make_date(2025, m, 1)), '%d-%m-%Y') WHEN 1 THEN strftime(last_day(make_date(2023, m, 1)), '%d-%m-%Y') END AS period,
  CASE c_custkey % 4 WHEN 2 THEN strftime(last_day(make_date(2022, m, 1)), '%d-%m-%Y') WHEN 3 THEN '31-05-2020' WHEN 0 THEN '31-05-2020' ELSE '31-05-2020' END AS named
FROM (SELECT c_custkey, CAST(c_custkey % 12 + 1 AS INT) AS m FROM customer)
""")
def periods_of_names(spark, sf_dir):
    m = F.lpad((_key() % 12 + 1).cast("string"), 2, "0")
    word = F.element_at(F.array(*[F.lit(x) for x in dates.MONTHS if x != "SETIEMBRE"]), (_key() % 12 + 1).cast("int"))
    name = F.when(_key() % 4 == 0, F.concat(F.lit("liq 2025-"), m, F.lit("-17 x"))).when(_key() % 4 == 1, F.concat(F.lit("2023"), m, F.lit("09"))).when(_key() % 4 == 2, F.concat(F.lit("Resumen "), F.lower(word), F.lit(" de 2022"))).otherwise(F.lit("13-2020 x"))
    return _customers(spark, sf_dir, dates.period_of_dated_name(name).alias("period"), dates.period_of_name(name, F.lit("2020-05-09").cast("date")).alias("named"))


@query("""
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'MARZO 2024' WHEN 1 THEN '07/02/2024' WHEN 2 THEN NULL WHEN 3 THEN '01/01/2023' END AS page_period,
  CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN '08/02/2024' WHEN 2 THEN '' WHEN 3 THEN '02/02/2023' ELSE '05/05/2021' END AS block_date,
  CASE c_custkey % 5 WHEN 0 THEN '29-02-2024' WHEN 1 THEN '31-12-2024' WHEN 2 THEN '05-06-2024' WHEN 3 THEN 'sin periodo' ELSE '30-09-2024' END AS period_date FROM customer
""")
def dates_on_pages(spark, sf_dir):
    page = _picked(_key(), "periodo marzo   2024, 01", "el 07/02/2024 y 08/02/2024", "1/2/24", "01/01/2023 F. Pres 02/02/2023 y 03/03/2023", None)
    block = F.coalesce(page, F.lit("el día 05/05/2021 y 06/06/2021"))
    period = _picked(_key(), " febrero 2024", "12-2024", "05/06/2024", "sin periodo", "Setiembre 2024")
    return _customers(spark, sf_dir, dates.page_period(page).alias("page_period"), dates.block_date(block).alias("block_date"), dates.period_to_date(period).alias("period_date"))


@query(f"""
SELECT c_custkey, {_sql_picked('c_custkey', 'Cantidad,Codigo_Articulo,Total', 'UD,% Dto1,% Dto2,Bl/Pq', 'Importe_Lista,Importe_Neto,IVA,Impuestos internos', 'Moneda,AuxNroLote,AuxNroSerie', '', 'Descripcion')} AS columns,
  CASE c_custkey % 6 WHEN 0 THEN 3 WHEN 1 THEN 12 WHEN 2 THEN 7 END AS items FROM customer
""")
def voucher_notes(spark, sf_dir):
    note = _picked(_key(), "x\nDETALLE: Cant. ; Código de artículo | Total final\nCantidad de items: 3", "detalle:Unidad,Dto. 1,descuento 2,% 3,Bultos\ncantidad  de items 12", "Detalle: P. Lista, Precio unitario; IVA, Imp internos\nCANTIDAD DE ITEMS - 7", "detalle : Moneda|Nro lote|N. serie|otra", None, "Detalle: desc,descripción")
    columns = F.coalesce(F.array_join(classify.detail_columns(text.detail_headers(F.lit(""), note)), ","), F.lit(""))
    return _customers(spark, sf_dir, columns.alias("columns"), text.expected_items(F.lit(None).cast("string"), note).alias("items"))


@query(r"""
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'c:\a\b ' || c_custkey WHEN 1 THEN 'c:\a' WHEN 2 THEN '' ELSE NULL END AS path, CASE c_custkey % 4 WHEN 0 THEN 'C:/a//B ' || c_custkey WHEN 1 THEN 'C:\a' WHEN 2 THEN '' END AS bare,
  CASE c_custkey % 4 WHEN 1 THEN 'x_y' ELSE 'x' END AS safe, CASE c_custkey % 4 WHEN 0 THEN 'a b c' ELSE 'abc' END AS clean
FROM customer
""".replace("\\\\", "\\"))
def paths_and_names(spark, sf_dir):
    raw = F.when(_key() % 4 == 0, F.concat(F.lit('"C:/a//B '), _key().cast("string"), F.lit('/"'))).when(_key() % 4 == 1, F.lit("'C:\\a'")).when(_key() % 4 == 2, F.lit("")).otherwise(F.lit(None).cast("string"))
    bare = F.when(_key() % 4 == 0, F.concat(F.lit('"C:/a//B '), _key().cast("string"), F.lit('"'))).when(_key() % 4 == 1, F.lit("'C:\\a'")).when(_key() % 4 == 2, F.lit("")).otherwise(F.lit(None).cast("string"))
    odd = _picked(_key(), "///", " x y ", None, "__")
    return _customers(spark, sf_dir, text.norm_path(raw).alias("path"), text.unquote(bare).alias("bare"), text.safe_name(odd, "x").alias("safe"), text.clean_control(_picked(_key(), "a\tb\nc", "abc", "abc", "abc")).alias("clean"))


@query("""
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Arancel' WHEN 1 THEN '' WHEN 4 THEN 'a' END AS concept, CASE c_custkey % 5 WHEN 0 THEN '1,00 | x' WHEN 1 THEN '2' WHEN 4 THEN '' END AS total,
  c_custkey % 5 IN (2, 3) AS noise, CASE c_custkey % 5 WHEN 0 THEN 'ARANCEL X' WHEN 1 THEN '' WHEN 2 THEN '' WHEN 3 THEN 'TITULO' ELSE 'A' END AS label,
  CASE c_custkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS number, repeat('uno dos ', 6) || 'x' AS short FROM customer
""")
def answer_lines(spark, sf_dir):
    line = _picked(_key(), " Arancel | 1,00 | x", "| 2", "  ", "** Titulo **", "a|")
    parts = text.split_pipe(line)
    cut = text.truncate_concept(F.concat(F.repeat(F.lit("uno  dos\n"), 6), F.lit("xy")), 49)
    return _customers(spark, sf_dir, parts["concept"].alias("concept"), parts["total"].alias("total"), text.is_noise(line).alias("noise"), text.clean_label(line).alias("label"), text.first_int(line).alias("number"), cut.alias("short"))


@query("""
SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 1234.56 WHEN 1 THEN 1234.56 WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN -10.5 ELSE 10.5 END::DOUBLE AS nullable,
  CASE c_custkey % 6 WHEN 0 THEN 1234.56 WHEN 1 THEN 1234.56 WHEN 2 THEN 0 WHEN 3 THEN 0 WHEN 4 THEN -10.5 ELSE 10.5 END::DOUBLE AS zero,
  CASE c_custkey % 6 WHEN 0 THEN 1234.56 WHEN 1 THEN 1.23456 WHEN 4 THEN -10.5 WHEN 5 THEN -10.5 ELSE 0 END::DOUBLE AS ar,
  CASE c_custkey % 6 WHEN 0 THEN '1.234,56' WHEN 3 THEN NULL WHEN 5 THEN '10,50' END AS amounts FROM customer
""")
def amounts_with_garbage(spark, sf_dir):
    raw = _picked(_key(), "$ 1.234,56", "1,234.56", "1.234.567", None, "$ -10,5", "(10,5)")
    found = F.array_join(text.ar_amounts(_picked(_key(), "a 1.234,56 b", "1,2", "x", None, "12,3 4", "de 10,50")), ";")
    return _customers(spark, sf_dir, numbers.parse_nullable(raw).alias("nullable"), numbers.parse_zero(raw).alias("zero"), numbers.parse_ar(raw).alias("ar"), F.nullif(found, F.lit("")).alias("amounts"))


@query(f"""
SELECT c_custkey, {_sql_picked('c_custkey', 'TARJETA AMEX', 'TARJETA VISA', 'TARJETA CABAL', 'TARJETA MASTERCARD', 'TARJETA NARANJA', None)} AS by_text, CASE c_custkey % 6 WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE {_sql_picked('c_custkey', 'TARJETA AMEX', 'TARJETA VISA', 'TARJETA CABAL', 'TARJETA MASTERCARD', 'x', 'x')} END AS by_name,
  c_custkey % 2 = 0 AS generic, {_sql_picked('c_custkey', 'BANCO NACION', 'BANCO PATAGONIA', 'BANCO DEL SUR', 'BANCO BANCOR')} AS label, {_sql_picked('c_custkey', 'BNA', 'BPAT', None, None)} AS bank, {_sql_picked('c_custkey', 'AUTOMATICO_LIQUIDACION', 'AUTOMATICO_FACTURA', 'MANUAL')} AS task,
  CASE c_custkey % 3 WHEN 0 THEN 5.0 WHEN 1 THEN -3.0 ELSE 0 END::DOUBLE AS signed FROM customer
""")
def cards_banks_and_tasks(spark, sf_dir):
    body = _picked(_key(), "pago American  Express", "su Visa.", "CABAL", "mastercard", "Naranja", "visado")
    name = _picked(_key(), "american.pdf", "miVISA1.pdf", "cabal.pdf", "masterX.pdf", "x.pdf", "y.pdf")
    generic = classify.is_generic_card(_picked(_key(), "Tarjeta de crédito", "TARJETA VISA"))
    banks = _picked(_key(), "Banco de la Nación", "patagonia s.a.", "Banco del Sur", "bancor")
    kind, automatic = _picked(_key(), "tarjetas", "compras", "bancos"), F.lit(True)
    signed = numbers.ledger_sign(_picked(_key(), "TARJETA", "GASTO", "OTROS"), _picked(_key(), -5.0, 3.0, 0.001))
    return _customers(spark, sf_dir, classify.card_of_text(body).alias("by_text"), classify.card_of_name(name).alias("by_name"), generic.alias("generic"), classify.bank_label(banks).alias("label"), classify.bank_of_name(_picked(_key(), "extracto BNA", "Banco Patagonia", "otro", None)).alias("bank"), classify.route_task(kind, automatic).alias("task"), signed.cast("double").alias("signed"))


_WORDS = [["Arancel", "IVA", "Retención", "Percepción", "Impuesto", "Gasto", "Neto de pagos", "Tarjeta"], ["", "crédito", "ganancias", "s/arancel", "ing. brutos", "fiscal cred"], ["", "SIRTAC", "RG 2408", "comisión", "ret_gan"]]


def _class_sql() -> str:
    has = lambda *words: "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"
    tests = [
        (has("RET_GAN"), "RET_GAN"), (has("NETO DE PAGOS"), "BANCO"), (has("ARANCEL", "COMISION"), "GASTO"), (f"{has('IMPUESTO')} AND NOT {has('GANANCIAS')}", "GASTO"), (f"{has('GASTO')} AND NOT {has('CREDITO')}", "GASTO"),
        (f"({has('IVA')} AND {has('RET', 'PERCEP')}) OR {has('RG 2408')}", "RET_IVA"), (has("SIRTAC", "ING. BRUTOS"), "RET_IIBB"), (has("GANANCIAS"), "RET_GAN"), (f"{has('IVA')} AND {has('CREDITO', 'FISCAL CRED')}", "IVA_CREDITO"), (has("TARJETA"), "TARJETA"),
    ]
    return "CASE " + " ".join(f"WHEN {test} THEN '{name}'" for test, name in tests) + " ELSE 'OTROS' END"


@query(f"""
SELECT event_id, {_class_sql()} AS category FROM (SELECT event_id, upper(strip_accents(concat_ws(' ', {_sql_picked('event_id', *_WORDS[0])}, {_sql_picked('event_id // 8', *_WORDS[1])}, {_sql_picked('event_id // 48', *_WORDS[2])}))) AS t FROM events)
""")
def concept_classes(spark, sf_dir):
    n = F.col("event_id")
    concept = F.concat_ws(" ", _picked(n, *_WORDS[0]), _picked(F.expr("event_id div 8"), *_WORDS[1]), _picked(F.expr("event_id div 48"), *_WORDS[2]))
    return read(spark, sf_dir, "events").select("event_id", classify.classify_concept(concept).alias("category"))


@query("""
SELECT conv_id, turn, CASE WHEN turn + 1 = 1 THEN 'TARJETA' WHEN conv_id % 2 = 0 AND turn + 1 <= 8 THEN (['TARJETA', 'BANCO', 'GASTO', 'IVA_CREDITO', 'RET_IVA', 'RET_IIBB', 'RET_GAN', 'OTROS'])[turn + 1] ELSE 'OTROS' END AS category FROM conversations
""")
def positional_categories(spark, sf_dir):
    concept = F.when(F.col("conv_id") % 2 == 0, "Otros").otherwise("otra cosa")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", classify.positional_category(classify.classify_concept(concept), concept, F.col("turn") + 1).alias("category"))


@query("SELECT c_custkey % 100 AS id, arg_max(c_name, c_custkey) AS route FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 GROUP BY 1")
def last_routes(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.when(_key() % 7 == 0, "x9").otherwise((_key() % 100).cast("string")).alias("idcliente"), F.when(_key() % 5 == 0, " ").otherwise(F.col("c_name")).alias("ruta"))
    return ingest.last_route(rows, "idcliente", "ruta", "c_custkey")


@query("SELECT 'K' || c_custkey AS key, CASE c_custkey % 3 WHEN 0 THEN 'a=b' ELSE c_name END AS value FROM customer WHERE c_custkey % 4 <> 3")
def env_lines(spark, sf_dir):
    value = F.when(_key() % 3 == 0, "'a=b'").otherwise(F.concat(F.lit('"'), "c_name", F.lit('"')))
    line = F.when(_key() % 8 == 3, "# K=1").when(_key() % 8 == 7, "sin valor").otherwise(F.concat(F.lit(" K"), _key().cast("string"), F.lit(" = "), value))
    return ingest.env_entries(read(spark, sf_dir, "customer").select(line.alias("value")))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'OK' WHEN 1 THEN 'ERROR' END AS status FROM events")
def status_lines(spark, sf_dir):
    log = _picked(F.col("event_id"), "hora 1\nSTATUS= ok \nSTATUS=ERROR", "STATUS=Error", "XSTATUS=OK\nnada")
    return read(spark, sf_dir, "events").select("event_id", ingest.status_of_log(log).alias("status"))


@query("SELECT c_nationkey AS id, count(DISTINCT c_custkey % 10) AS n FROM customer GROUP BY 1")
def path_lists(spark, sf_dir):
    """Paths of several spellings; each once, without its kind of documents."""
    rows = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("id"), (_key() % 10).cast("string").alias("p")).groupBy("id").agg(F.array_join(F.collect_list(F.concat(F.lit('"C:/Datos/'), "p", F.lit('";c:\\\\datos\\'), "p", F.lit("\\"))), "\n").alias("list"))
    return ingest.split_paths(rows, ["list"], ["id"]).groupBy("id").agg(F.count("*").cast("long").alias("n"))


@query("""
SELECT CAST(c_custkey AS VARCHAR) || '.pdf' AS name, CASE WHEN c_custkey % 4 = 1 THEN 'SKIP' WHEN c_custkey % 5 = 0 THEN 'NOT_READY' ELSE 'READY' END AS outcome FROM customer
""")
def incremental_plan(spark, sf_dir):
    """Kinds of files: no entry, OK, ERROR, and an OK that has expired; every fifth is still too young."""
    now = F.lit("2025-01-10 12:00:00").cast("timestamp")
    name = F.concat(_key().cast("string"), F.lit(".pdf"))
    files = _customers(spark, sf_dir, name.alias("name"), F.lit(5).cast("long").alias("length"), F.when(_key() % 5 == 0, now - F.expr("interval 10 seconds")).otherwise(now - F.expr("interval 5 minutes")).alias("modificationTime")).drop("c_custkey")
    entries = read(spark, sf_dir, "customer").where("c_custkey % 4 <> 0").select(name.alias("name"), _picked(_key(), "x", "OK", "ERROR", "OK").alias("status"), F.when(_key() % 4 == 3, now - F.expr("interval 8 days")).otherwise(now - F.expr("interval 1 day")).alias("ts"))
    return agent.plan_run(files, entries, now).select("name", "outcome")


@query("SELECT user_id, CAST(sum(CASE WHEN event_type IN ('click', 'view') THEN 2 ELSE 1 END) AS DOUBLE) AS total FROM events GROUP BY 1")
def captures_summed(spark, sf_dir):
    line = F.when(F.col("event_type").isin("click", "view"), "arancel $ 1,00 x ARANCEL- 1,00").otherwise("Arancel 1 nada")
    rows = read(spark, sf_dir, "events").select("user_id", settlement.sum_matches(line, settlement.PAGE_SUMS["fees"]).alias("x"))
    return rows.groupBy("user_id").agg(F.sum("x").alias("total"))


@query("SELECT o_orderkey, o_totalprice AS total, CAST(10 AS DOUBLE) AS net FROM orders WHERE o_totalprice > 10")
def header_amounts_near_labels(spark, sf_dir):
    page = F.concat(F.lit("0,00 999.999,99\nTOTAL PRESENTADO $ 10,00 y "), _ar(F.col("o_totalprice")), F.lit(" 0,00"), F.repeat(F.lit("."), 230), F.lit("neto de pagos 10,00"))
    two = ledger.two_largest(settlement.header_amounts(page))
    return read(spark, sf_dir, "orders").where("o_totalprice > 10").select("o_orderkey", F.get(two, 0).alias("total"), F.get(two, 1).alias("net"))


@query("SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE event_id END AS k, event_id % 4 = 3 AS bad FROM events")
def json_with_faults(spark, sf_dir):
    n = F.col("event_id").cast("string")
    body = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"k":'), n, F.lit("}"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit('\ufeffx {"k":'), n, F.lit(',"a":[1,2,],} y'))).when(F.col("event_id") % 4 == 2, F.concat(F.lit('```json\n{"a":{"b":null},"k": '), n, F.lit("}\n```"))).otherwise(F.lit("{k: nada"))
    v = jsontext.parse(body)
    return read(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), v.isNull().alias("bad"))


@query("SELECT conv_id, concat_ws(',', max(role) FILTER (role = 'user'), string_agg(DISTINCT role, ',' ORDER BY role) FILTER (role <> 'user')) AS columns FROM conversations GROUP BY 1")
def preferred_columns(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(frames.ordered_columns(F.collect_set("role"), ["zz", "user"]).alias("c"))
    return rows.select("conv_id", F.array_join("c", ",").alias("columns"))


@query("""
SELECT c_custkey, '{' || CASE c_custkey % 3 WHEN 0 THEN '"task":"AUTO","opcion":"AUTO",' ELSE '' END || '"idcliente":"' || c_custkey || '"' || CASE WHEN c_custkey % 2 = 0 THEN ',"source_filename":"' || c_name || '","archivo_nombre":"' || c_name || '","filename":"' || c_name || '","archivoNombre":"' || c_name || '","file_name":"' || c_name || '"' ELSE '' END || '}' AS body FROM customer
""")
def request_bodies(spark, sf_dir):
    pairs = jsontext.request_names(_picked(_key(), " auto", "", None), _key().cast("string"), F.when(_key() % 2 == 0, F.col("c_name")).otherwise(" "))
    return _customers(spark, sf_dir, jsontext.request(*pairs).alias("body"))


@query("""
WITH RECURSIVE p AS (SELECT o_custkey AS doc, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS page, CAST(round(o_totalprice * 100) AS BIGINT) AS size FROM orders),
s AS (SELECT doc, page, sum(size) OVER (PARTITION BY doc ORDER BY page) AS upto FROM p),
r AS (SELECT doc, 1 AS first, max(page) AS last, 1 AS round FROM p GROUP BY 1
  UNION ALL SELECT doc, h.first, h.last, round + 1 FROM (
    SELECT r.*, unnest([{'first': r.first, 'last': r.first + (r.last - r.first) // 2}, {'first': r.first + (r.last - r.first) // 2 + 1, 'last': r.last}]) AS h
    FROM r JOIN s b ON b.doc = r.doc AND b.page = r.last LEFT JOIN s a ON a.doc = r.doc AND a.page = r.first - 1 WHERE r.last > r.first AND b.upto - coalesce(a.upto, 0) > 40000000)),
z AS (SELECT r.*, b.upto - coalesce(a.upto, 0) AS size FROM r JOIN s b ON b.doc = r.doc AND b.page = r.last LEFT JOIN s a ON a.doc = r.doc AND a.page = r.first - 1)
SELECT CAST(doc AS VARCHAR) AS doc, CAST(first AS INT) AS first, CAST(last AS INT) AS last, CAST(round AS INT) AS round, CASE WHEN size > 40000000 THEN NULL ELSE CAST(size AS VARCHAR) END AS text FROM z WHERE first = last OR size <= 40000000""")
def ranges_by_halves(spark, sf_dir):
    """A page for each order of a customer; requests for pages of more than 400,000 in all are too large and halved."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("doc"), "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("size"))
    pages = frames.numbered(orders, ["doc"], ["o_orderkey"], "page")

    def ask(ranges):
        sizes = ranges.join(pages, "doc").where("page between first and last").groupBy("doc", "first", "last").agg(F.sum("size").alias("size"))
        large = F.col("size") > 40_000_000
        return sizes.select("doc", "first", "last", F.when(~large, F.col("size").cast("string")).alias("text"), F.when(large, "HTTP 413: too large").alias("error"))

    ranges = pages.groupBy("doc").agg(F.lit(1).alias("first"), F.max("page").alias("last"))
    return documents.answers_by_halves(ranges, ask)[0].select("doc", "first", "last", "round", "text")


#: Files that lie in the shared folder at once, 4 KB of disk each at least.
FILES_AT_ONCE = 50_000


@query("""
WITH l AS (SELECT l_orderkey AS doc, count(*) AS n, CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS q FROM lineitem GROUP BY 1)
SELECT CAST(doc AS VARCHAR) AS doc, CASE WHEN o_orderkey % 3 = 0 THEN '{"a":[1,{"b":null}],"c":1.25}' ELSE CAST(o_custkey AS VARCHAR) END AS extra, o_orderkey % 2 = 0 AS flag, n AS n_rows, q AS quantity, '"second"' AS total, '[]' AS listed
FROM l JOIN orders ON o_orderkey = doc""")
def typed_documents(spark, sf_dir):
    """A page for each half of an order's lines, with numbers, flags and nested fields, merged and written as a file each.

    A file takes a disk block at least, so the files of FILES_AT_ONCE documents are written and read again, and then give way to the next.
    """
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") > 3).cast("int").alias("page_no"), F.col("l_quantity").cast("int").alias("Cantidad"))
    rows = lines.groupBy("doc").agg(*[F.collect_list(F.when(F.col("page_no") == k, F.struct("Cantidad"))).alias(f"rows{k}") for k in (0, 1)])
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), "o_custkey").join(rows, "doc")
    nested = F.when(F.col("doc") % 3 == 0, F.lit('{"c":1.25,"a":[1,{"b":null}]}')).otherwise(F.col("o_custkey").cast("string"))
    text = lambda k, extra, total: F.concat(F.lit('{"CAB":{"Extra":'), extra, F.lit(',"Flag":'), (F.col("doc") % 2 == 0).cast("string"), F.lit('},"ROWS":'), F.to_json(f"rows{k}"), F.lit(',"TOTALES":{"Total":"'), F.lit(total), F.lit('"},"meta":{}}'))
    pages = orders.select(F.col("doc").cast("string").alias("doc"), F.inline(F.array(*[F.struct(F.lit(k).alias("page_no"), t.alias("text")) for k, t in enumerate([text(0, nested, "first"), text(1, F.lit("null"), "second")])])))
    digests = shared_folder(spark, "digests")
    for some in in_parts(invoice_json.merged_documents(pages), "merged", FILES_AT_ONCE):
        at = invoice_json.write_json(some, shared_folder(spark, "invoices"))
        try:
            _typed_digests(spark, at).write.mode("append").parquet(digests)
        finally:
            removed(spark, at)
    return spark.read.parquet(digests)


def _typed_digests(spark, folder: str) -> DataFrame:
    """Of each file of a folder what the SQL computes."""
    got = read_files(spark, folder).select(F.regexp_extract("name", r"(.*)\.json$", 1).alias("doc"), F.parse_json(F.col("content").cast("string")).alias("v"))
    quantities = F.try_variant_get("v", "$.ROWS", "array<struct<Cantidad:int>>")
    as_json = lambda path: F.to_json(F.variant_get("v", path, "variant"))
    return got.select("doc", as_json("$.CAB.Extra").alias("extra"), F.variant_get("v", "$.CAB.Flag", "boolean").alias("flag"), F.size(quantities).cast("long").alias("n_rows"), F.aggregate(quantities, F.lit(0).cast("long"), lambda a, x: a + x["Cantidad"]).alias("quantity"), as_json("$.TOTALES.Total").alias("total"), as_json("$.meta.orden_columnas").alias("listed"))
