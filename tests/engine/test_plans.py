import datetime as dt
import json

from pyspark.sql import functions as F

from cuadra.operators import classify, ingest
from cuadra.plans import agent, bank, invoice, settlement
from cuadra.operators.ledger import ledger_text

CELLS = "file string, sheet_name string, row_no int, cells array<string>, nums array<double>"


def _sheet(spark):
    rows = [["BANCO NACION"], ["Fecha", "Comprobante", "Concepto", "Importe"], ["02/01/2025", "1", "COMISION MANTENIMIENTO", "-1.000,00"], ["02/01/2025", "2", "IVA ALICUOTA 21%", "-252,00"], [45662.0, "3", "GRAVAMEN LEY 25413 S/DEB", "-60,00"], ["2025-01-06", "4", "TRANSFER RECIBIDA", "5.000,00"], ["07/01/2025", "5", "IVA PERCEPCION RG 2408", "-30,00"], ["08/01/2025", "6", "PAGO SERVICIO LUZ", "-400,00"], ["", "", "SALDO", "100"]]
    data = [("extracto 01-2025.xls", "Hoja1 - Table 1", k, [str(int(v)) if isinstance(v, float) else v for v in r], [v if isinstance(v, float) else None for v in r]) for k, r in enumerate(rows, 1)]
    return spark.createDataFrame(data, CELLS)


def test_bank_statement(spark):
    rules, out = classify.read_rules(spark)
    rows = bank.statement_rows(_sheet(spark)).cache()
    assert rows.count() == 6 and rows.where("bank = 'BNA'").count() == 6
    done = bank.classified(rows, rules, out)
    got = {r.category: float(r.amount) for r in bank.ledger(done).collect()}
    assert got == {"BANCO": 1542.0, "GASTO": -1000.0, "NETO GRAVADO POR AJUSTE IVA": -200.0, "IDC_A_COMPUTAR": -60.0, "IVA_CREDITO": -252.0, "RET_IVA": -30.0, "RET_IIBB": 0.0, "RET_GAN": 0.0, "OTROS": 0.0}
    c = bank.controls(done)
    assert [r.concept for r in c["concepts"].collect()][0] == "COMISION MANTENIMIENTO"
    assert c["vat"].first().alert and c["counts"].first()[1:] == (5, 4)
    assert c["unknown"].first().concept == "PAGO SERVICIO LUZ"
    text = ledger_text(bank.ledger(done), ["file"]).first().text
    assert text.startswith("BANCO|1542.00\nGASTO|-1000.00\n") and len(text.splitlines()) == 9


PAGE = "doc string, file string, page_no int, text string"
LINES = ["BANCO NACION", "VENTAS C/DESCUENTO CONTADO+ $ 1.000,00", "ARANCEL- $ 18,00", "IVA CRED.FISC.COMERCIO S/ARANC 21,00% $ 3,78", "IMPORTE NETO DE PAGOS $ 978,22", "VENTAS C/DESCUENTO CONTADO+ $ 500,00"]


def test_settlement_of_nacion(spark):
    pages = spark.createDataFrame([("d", "d.pdf", 1, "\n".join(LINES[:5])), ("d", "d.pdf", 2, LINES[5])], PAGE)
    none = spark.createDataFrame([], "doc string, text string")
    assert {(r.label, r.amount) for r in settlement.sequential_blocks(pages).collect()} == {("VENTAS C/DESCUENTO CONTADO", 1000.0), ("ARANCEL", 18.0), ("IVA CRED.FISC.COMERCIO S/ARANC 21,00%", 3.78), ("IMPORTE NETO DE PAGOS", 978.22)}
    got = [(r.category, float(r.amount)) for r in settlement.ledger(pages, none).orderBy("ord").collect()]
    assert [v for _, v in got] == [1000.0, -18.0, -3.78, -978.22]
    f = settlement.document_facts(pages).first()
    assert f.nacion and not f.patagonia and f.sales == 1500.0 and f.vat == 21.0 and f.bank_name == "BANCO DE LA NACION ARGENTINA"


def test_settlement_by_page_sums_and_answer(spark):
    pages = spark.createDataFrame([("d", "visa.pdf", 1, "\n".join(LINES[1:5])), ("e", "x.pdf", 1, "nada")], PAGE)
    answers = spark.createDataFrame([("d", "CONCEPTO|TOTAL\nTARJETA|1\nRET IIBB SIRTAC|5,00\n"), ("e", "```\nTARJETA|100,00\nNETO DE PAGOS|90,00\nARANCEL|4\nARANCEL|6\n")], "doc string, text string")
    got = {}
    for r in settlement.ledger(pages, answers).orderBy("ord").collect():
        got.setdefault(r.doc, {})[r.category] = float(r.amount)
    assert got["d"] == {"TARJETA": 1000.0, "BANCO": -978.22, "GASTO": -18.0, "IVA_CREDITO": -3.78, "RET_IVA": 0.0, "RET_IIBB": -5.0, "RET_GAN": 0.0, "OTROS": 5.0}
    assert got["e"]["GASTO"] == -6.0 and got["e"]["OTROS"] == -4.0
    assert all(abs(sum(v.values())) < 0.01 for v in got.values())
    blocks = settlement.anchored_blocks(pages).collect()
    assert len({r.block_key for r in blocks}) == 1 and len(blocks) == 4


def test_patagonia(spark):
    text = "BANCO PATAGONIA\nTOTAL PRESENTADO $ 1.000,00\nTOTAL DESCUENTO $ 50,00\nSALDO $ 950,00\nDESGLOSE DE DESCUENTOS\nArancel Tj.C $ 40,00\nBase Imponible IVA $ 40,00\nIVA 21\n% 21,00 $ 8,40\nDolares U$S 9,00\n____\nIGNORADO $ 7,00"
    pages = spark.createDataFrame([("p", "p.pdf", 1, text)], PAGE)
    got = [(r.label, r.amount) for r in settlement.patagonia_breakdown(pages).orderBy("k").collect()]
    assert got == [("BASE IMPONIBLE IVA", 40.0), ("IVA 21", 8.4)]
    done = [(r.category, float(r.amount)) for r in settlement.ledger(pages, spark.createDataFrame([], "doc string, text string")).orderBy("ord").collect()]
    assert done[0] == ("TOTAL PRESENTADO", 1000.0) and done[-1] == ("SALDO", -950.0)


def test_invoices(spark):
    row = lambda code, total: {"Codigo_Articulo": code, "Descripcion": "x", "Cantidad": "2", "Bl/Pq": "1 un", "Total": total}
    pages = [("i", 1, "texto " + json.dumps({"CAB": {"Nombre": "", "CUIT": "1"}, "ROWS": [row("a", "4,00"), row("a", "4,00"), "malo"], "TOTALES": {"Total": "10"}, "meta": {"comprobante_raw": "Detalle: Codigo, Dto, Total\ncantidad de items: 2"}})[:-1] + ",} fin"), ("i", 2, json.dumps({"CAB": {"Nombre": "LA VIRGINIA SA", "CUIT": "2"}, "ROWS": [row("b", "6,00")], "TOTALES": {"Total": ""}})), ("j", 1, "nada")]
    got = invoice.normalize(spark.createDataFrame(pages, "doc string, page_no int, text string")).cache()
    assert got.where("bad").count() == 1
    docs = invoice.merge(got).cache()
    d = docs.first()
    assert (d.CAB["Nombre"], d.CAB["CUIT"], d.TOTALES["Total"]) == ("LA VIRGINIA SA", "1", "10")
    assert set(invoice.HEAD) <= set(d.CAB) and set(invoice.TOTALS) <= set(d.TOTALES) and set(invoice.META) <= set(d.meta) and [tuple(o) for o in d.others] == [("", "")]
    rows = invoice.detail_rows(docs)
    assert [(r.Codigo_Articulo, r.price, r.Importe_Lista) for r in rows.orderBy("pos").collect()] == [("a", 2.0, "2,000"), ("b", 3.0, "3,000")]
    q = invoice.checked(docs, rows).first()
    assert q.good and q.row_total == 10.0 and q.expected == 2 and not q.flagged
    assert docs.select(invoice.column_order(docs)).first()[0] == ["Codigo_Articulo", "% Dto1", "Total"]
    plain = docs.withColumn("meta", F.create_map(F.lit("comprobante_raw"), F.lit("")))
    assert plain.select(invoice.column_order(plain)).first()[0] == invoice.COMMON
    listed = docs.withColumn("order_columns", F.array(F.lit("Total")))
    assert listed.select(invoice.column_order(listed)).first()[0] == ["Total"]


def test_invoice_keeps_every_field(spark):
    body = {"CAB": {"Proveedor": "P", "CAE": "7", "Raro": None, "IDPROVINCIA": 4}, "ROWS": [{"Codigo_Articulo": "a", "Total": 1.5, "Tot.Imp.Int": "9"}, {"Codigo_Articulo": "a", "Importe_Neto": "2"}, {}], "TOTALES": {"IVA 21%": "3", "Otros": [{"Etiqueta": "flete", "Importe_Neto": "4"}, "x", {"Etiqueta": "b"}]}, "meta": {"orden_columnas": ["Total", "UD"]}}
    pages = [("i", 1, json.dumps(body)), ("i", 2, json.dumps({"ROWS": "nada", "TOTALES": []})), ("k", 1, "{}")]
    docs = invoice.merge(invoice.normalize(spark.createDataFrame(pages, "doc string, page_no int, text string")))
    i, k = docs.orderBy("doc").collect()
    assert (i.CAB["Proveedor"], i.CAB["CAE"], i.CAB["Raro"], i.CAB["IDPROVINCIA"], i.TOTALES["IVA 21%"], i.TOTALES["Exento"]) == ("P", "7", "", "4", "3", "")
    assert [tuple(o) for o in i.others] == [("flete", "4"), ("b", "")] and i.order_columns == ["Total", "UD"]
    assert len(i.rows) == 3 and i.rows[0]["Tot.Imp.Int"] == "9" and i.rows[0]["UD"] == "" and k.rows == []
    rows = invoice.detail_rows(docs).orderBy("pos").collect()
    assert [(r.Codigo_Articulo, r.Importe_Neto, r.Total) for r in rows] == [("a", "", "1.5"), ("a", "2", "")]


def test_headers_and_control_sheets(spark):
    rules, out = classify.read_rules(spark)
    cells = _sheet(spark)
    rows = bank.classified(bank.statement_rows(cells), rules, out)
    banks = bank.detect_bank(cells)
    assert bank.header_lines(banks, F.lit("2020-02-03").cast("date")).first().header == "BANCO DE LA NACION ARGENTINA\nGASTOS BANCARIOS\n31-01-2025\nGB 31-01-2025 BANCO DE LA NACION ARGENTINA\nCONCEPTO|IMPORTE\n"
    assert bank.ledger_lines(bank.ledger(rows), banks).where("ord = 0").first().category == "BANCO NACION"
    sheet = {(r.section, r.ord): (r.concept, r.n, r.amount and float(r.amount)) for r in bank.control_sheets(rows).collect()}
    assert sheet["CONCEPTOS", 1] == ("COMISION MANTENIMIENTO", 1, -1000.0) and sheet["ANALISIS", 1][1] == 5 and sheet["SIN REGLA", 1][0] == "PAGO SERVICIO LUZ"
    assert sheet["IVA", 5] == ("base_adjustment", None, 200.0)
    text = "Entidad Pagadora\nBANCO DE LA NACION ARGENTINA\nTARJETA DE CREDITO VISA\nENERO 2025\n" + "\n".join(LINES)
    facts = settlement.document_facts(spark.createDataFrame([("d", "d.pdf", 1, text)], PAGE))
    assert settlement.header_lines(facts).first().header.split("\n") == ["BANCO DE LA NACION ARGENTINA", "TARJETA VISA", "31-01-2025", "LIQ 31-01-2025 TARJETA VISA BANCO NACION", "CONCEPTO|IMPORTE", ""]
    day, total = settlement.daily_sheet(spark.createDataFrame([("d", "d.pdf", 1, text)], PAGE), facts).orderBy(F.col("block").isNull()).collect()
    assert (day.block, float(day.charges), float(day.check)) == (0, 21.78, 0.0) and total.doc == "d" and float(total["ARANCEL"]) == 18.0


def test_incremental_run(spark):
    now = dt.datetime(2025, 1, 10, 12)
    old, young = now - dt.timedelta(minutes=5), now - dt.timedelta(seconds=10)
    files = spark.createDataFrame([("a.pdf", 5, old), ("b.pdf", 5, young), ("c.pdf", 5, old), ("d.pdf", 5, old), ("e.pdf", 5, old), ("f.pdf", 0, old), ("Factura ACME 01-02 0001-00012345.pdf", 5, old), ("ACME 01-02 0001-00012345 OK.jpg", 5, old)], "name string, length long, modificationTime timestamp")
    ledger = spark.createDataFrame([("c.pdf", "OK", old), ("d.pdf", "ERROR", old), ("e.pdf", None, old)], "name string, status string, ts timestamp")
    t = F.lit(now)
    got = {r.name: r.outcome for r in agent.plan_run(files, ledger, t).collect()}
    assert {k: got[k] for k in ("a.pdf", "b.pdf", "c.pdf", "d.pdf", "e.pdf", "f.pdf")} == {"a.pdf": "READY", "b.pdf": "NOT_READY", "c.pdf": "SKIP", "d.pdf": "READY", "e.pdf": "SKIP", "f.pdf": "NOT_READY"}
    entries = agent.run(files, ledger, lambda g: g.select("document", F.lit("OK").alias("status"), F.col("n").cast("string").alias("message")), t).collect()
    assert {(r.name, r.message) for r in entries if "ACME" in r.name} == {("Factura ACME 01-02 0001-00012345.pdf", "2"), ("ACME 01-02 0001-00012345 OK.jpg", "2")}
    assert len(entries) == 4


def test_paths_and_catalog(spark):
    rows = spark.createDataFrame([(1, '"C:\\a";C:\\b\nC:/A', "C:\\c\\tarjetas\\")], "id int, RUTAS string, RUTA string")
    assert [r.path for r in ingest.split_paths(rows, ["RUTAS", "RUTA"], ["id"]).orderBy("pos").collect()] == ["C:\\a", "C:\\b", "C:\\c\\tarjetas\\"]
    assert rows.select(ingest.base_path(F.col("RUTA"))).first()[0] == "C:\\c"
    assert spark.createDataFrame([("x\nSTATUS= ok \nSTATUS=ERROR",)], "t string").select(ingest.status_of_log(F.col("t"))).first()[0] == "OK"
    env = ingest.env_entries(spark.createDataFrame([("A='1=2'",), ("# b=1",), ("",), ("c",)], "value string"))
    assert [tuple(r) for r in env.collect()] == [("A", "1=2")]


def test_rules_of_a_file(spark, tmp_path):
    book = {"banks": {"X": {"rules": [{"match": "agua", "mode": "contains", "category": "gasto"}, {"match": " ", "mode": "regex"}, {"match": "^LUZ"}], "exclusions": ["no"]}}}
    (tmp_path / "r.json").write_text(json.dumps(book))
    rules, out = classify.read_rules(spark, str(tmp_path / "r.json"))
    rows = spark.createDataFrame([("X", "Pago ÁGUA"), ("X", "no agua"), ("Y", "agua"), ("X", "otra")], "bank string, concept string")
    got = {(r.bank, r.concept): r.category for r in bank.classified(rows, rules, out).collect()}
    assert got == {("X", "Pago ÁGUA"): "GASTO", ("Y", "agua"): None, ("X", "otra"): None}
