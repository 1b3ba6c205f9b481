import json
import os

import pytest
from pyspark.sql import functions as F

from cuadra.operators import classify
from cuadra.plans import bank

CELLS = "file string, sheet_name string, row_no int, cells array<string>, nums array<double>"
BOOK = {
    "BNA": bank.BANKS["BNA"],
    "BX": {"bank_name": "BANCO EQUIS", "detect": {"sheet_name_contains": ["movs"], "headers_any": ["Día", "Detalle"]}, "columns": {"date": "Día", "description": "Detalle", "debit": "Egreso", "credit": "Ingreso"}, "rules": [{"match": "comisión", "category": "gasto"}, {"match": "^iva", "mode": "regex", "category": "IVA_CREDITO"}], "exclusions": ["transfer"]},
}


def _sheet(spark, *files):
    return spark.createDataFrame([(f, s, k, c, [None] * len(c)) for f, s, rows in files for k, c in enumerate(rows, 1)], CELLS)


MOVS = [["Cuenta 1"], ["DIA", "Detalle mov.", "Egreso", "Ingreso"], ["01/02/2024", "Comisión\tmensual", "1.000,00", ""], ["02/02/2024", "IVA 21", "220,00", ""], ["03/02/2024", "Transfer X", "9,00", ""], ["04/02/2024", "Luz", "", "3,00"], ["04/02/2024", "Luz", "", "3,00"], ["x", "Luz", "", "3,00"]]


def test_a_bank_that_only_a_file_knows(spark, tmp_path):
    path = str(tmp_path / "book.json")
    with open(path, "w") as f:
        json.dump({"banks": BOOK}, f)
    banks = bank.read_banks(spark, path)
    rules, out = classify.read_rules(spark, path)
    cells = _sheet(spark, ("enero 2024.xlsx", "Movs 1", MOVS))
    assert [tuple(r) for r in bank.detect_bank(cells, banks).collect()] == [("enero 2024.xlsx", "BX", 2)]
    assert bank.detect_bank(cells).first().bank is None
    at = bank.write_statements(cells, rules, out, F.lit("2020-01-01").cast("date"), str(tmp_path / "out"), banks)
    got = {n: open(os.path.join(at, n), encoding="utf-8").read() for n in os.listdir(at)}
    assert got["enero 2024.txt"] == "BANCO EQUIS\nGASTOS BANCARIOS\n31-01-2024\nGB 31-01-2024 BANCO EQUIS\nCONCEPTO|IMPORTE\nBANCO EQUIS|1267.62\nGASTO|-1000.00\nNETO GRAVADO POR AJUSTE IVA|-47.62\nIDC_A_COMPUTAR|0.00\nIVA_CREDITO|-220.00\nRET_IVA|0.00\nRET_IIBB|0.00\nRET_GAN|0.00\nOTROS|0.00\n"
    assert got["enero 2024.log"] == "archivo=enero 2024.xlsx\nbanco=BX\nsheet=Movs 1\nrows_analyzed=5\nrows_matched=2\ntotal_BANCO=1267.62\ntotal_GASTO=-1000.00\ntotal_NETO_GRAVADO_POR_AJUSTE_IVA=-47.62\ntotal_IDC_A_COMPUTAR=0.00\ntotal_IVA_CREDITO=-220.00\ntotal_RET_IVA=0.00\ntotal_RET_IIBB=0.00\ntotal_RET_GAN=0.00\ntotal_OTROS=0.00\nno_clasificados_top20:\n- Luz | cnt=2\n"
    assert got["enero 2024_control_conceptos.xls"].split("\n") == [
        "LINEA\tCONCEPTO\tCATEGORIA\tCANTIDAD\tIMPORTE_TOTAL", "1\tComisión mensual\tGASTO\t1\t-1000.00", "2\tIVA 21\tIVA_CREDITO\t1\t-220.00", "3\tNETO GRAVADO POR AJUSTE IVA\tNETO_GRAVADO_POR_AJUSTE_IVA\t1\t-47.62", "",
        "RESUMEN_POR_CATEGORIA\t\t\t\t", "LINEA\tCATEGORIA\tIMPORTE_TOTAL\t\t", "1\tBANCO\t1267.62\t\t", "2\tGASTO\t-1000.00\t\t", "3\tNETO_GRAVADO_POR_AJUSTE_IVA\t-47.62\t\t", "4\tIDC_A_COMPUTAR\t0.00\t\t", "5\tIVA_CREDITO\t-220.00\t\t", "6\tRET_IVA\t0.00\t\t", "7\tRET_IIBB\t0.00\t\t", "8\tRET_GAN\t0.00\t\t", "9\tOTROS\t0.00\t\t", "",
        "IVA_21_CONTROL\t\t\t\t", "BASE_GASTO_21\tIVA_TEORICO_21\tIVA_CREDITO_REAL\tDIFERENCIA\tAJUSTE_NETO_GRAVADO\tBASE_AJUSTADA\tIVA_TEORICO_AJUSTADO\tDIF_POST_AJUSTE", "1000.00\t210.00\t220.00\t10.00\t47.62\t1047.62\t220.00\t0.00", "ALERTA_IVA_21\tDIFERENCIA detectada: 10.00. Se sugiere ajuste neto gravado: 47.62\t\t\t", "",
    ]


def test_books_by_precedence(spark, tmp_path):
    paths = {n: str(tmp_path / f"{n}.json") for n in ("given", "beside", "bundled", "none")}
    for n in ("given", "beside", "bundled"):
        with open(paths[n], "w") as f:
            json.dump({"banks": {n: {}}}, f)
    assert list(bank.read_banks(spark, paths["given"], paths["beside"])) == ["given"]
    assert list(bank.read_banks(spark, None, paths["beside"], paths["bundled"])) == ["beside"]
    assert list(bank.read_banks(spark, None, paths["none"], paths["bundled"])) == ["bundled"]
    assert bank.read_banks(spark) is bank.BANKS and bank.read_banks(spark, paths["none"], paths["beside"]) is bank.BANKS
    for bad in ("{", "[]", '{"banks": []}', '{"banks": {"a": 1}}'):
        with open(paths["given"], "w") as f:
            f.write(bad)
        with pytest.raises(ValueError, match="no rule book"):
            bank.read_banks(spark, paths["given"])


def test_banks_by_name_and_text(spark):
    files = [
        ("bpat nacion.xls", "s", [["x"]]), ("nac 1.xls", "s", [["x"]]), ("a.xls", "VertVert", [["x"]]), ("b.xls", "hoja1 table", [["x"]]), ("c.xls", "s", [["x"], ["Movimientos de  cuenta"]]), ("d.xls", "s", [["Débito"], ["Crédito", "Descripción"]]),
        ("e.xls", "s", [["Últimos movimientos"]]), ("f.xls", "s", [["comprobante", "concepto"], ["importe"]]), ("g.xls", "s", [["x"]] * 80 + [["BANCO NACION"]]), ("h.xls", "s", [["a"] * 8 + ["BANCO NACION"]]), ("i.xls", "HOJA1", [["fecha", "comprobante", "concepto"], ["Fecha x", "Comprobante y", "Concepto", "Importe"]]),
    ]
    got = {r.file: (r.bank, r.header_row) for r in bank.detect_bank(_sheet(spark, *files)).collect()}
    assert got == {"bpat nacion.xls": ("BPAT", None), "nac 1.xls": ("BNA", None), "a.xls": ("BPAT", None), "b.xls": ("BNA", None), "c.xls": ("BPAT", None), "d.xls": ("BPAT", None), "e.xls": ("BNA", None), "f.xls": ("BNA", None), "g.xls": (None, None), "h.xls": (None, None), "i.xls": ("BNA", 1)}
