import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from cuadra.functions import dates, jsontext, numbers, text
from cuadra.operators import classify

AMOUNTS = [
    ("1.234,56", 1234.56, 1234.56, 1234.56), ("1,234.56", 1234.56, 1234.56, 1.23456), ("1.234", 1.234, 1.234, 1.234), ("1.234.567", None, 0.0, 0.0),
    ("$ -10,5", -10.5, -10.5, -10.5), ("(10,5)", 10.5, 10.5, -10.5), ("5-", None, 0.0, 0.0), ("", None, 0.0, 0.0), (None, None, 0.0, 0.0), ("abc", None, 0.0, 0.0),
]


def test_amounts(spark):
    df = spark.createDataFrame([(k, a[0]) for k, a in enumerate(AMOUNTS)], "k int, t string")
    t = F.col("t")
    for k, a, b, c in df.select("k", numbers.parse_nullable(t), numbers.parse_zero(t), numbers.parse_ar(t)).collect():
        assert (a, b, c) == AMOUNTS[k][1:], AMOUNTS[k]


def _one(spark, column, **values):
    kinds = {str: "string", float: "double", int: "int"}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {kinds[type(v)]}" for n, v in values.items())).select(column).first()[0]


@pytest.mark.parametrize("concept, category", [("IVA S/ARANCEL", "GASTO"), ("PERCEPCION IVA", "RET_IVA"), ("Percepción IVA", "RET_IVA"), ("SIRTAC", "RET_IIBB"), ("GASTO IVA", "IVA_CREDITO"), ("RG 830", "RET_GAN"), ("IMPUESTO SELLOS", "GASTO"), ("Tarjeta Visa", "TARJETA"), ("NETO A COBRAR", "BANCO"), ("cosa", "OTROS")])
def test_concepts(spark, concept, category):
    assert _one(spark, classify.classify_concept(F.col("c")), c=concept) == category


@pytest.mark.parametrize("name, period", [("extracto 01-2025.xls", "31-01-2025"), ("Febrero 2024", "29-02-2024"), ("setiembre-2023.xls", "30-09-2023"), ("nada", "30-06-2020"), ("x 112-2025", "30-06-2020")])
def test_periods(spark, name, period):
    assert _one(spark, dates.period_of_name(F.col("n"), F.lit("2020-06-05").cast("date")), n=name) == period


def test_dates(spark):
    rows = [(45662.0, "45662", "05/01/2025"), (None, "2025-01-06T10:00", "06/01/2025"), (None, "45662", None), (None, "99/99/2025", "99/99/2025"), (100.0, "100", None)]
    got = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(rows)], "k int, n double, t string").select("k", dates.parse_date(F.col("t"), F.col("n")))
    assert all(d == rows[k][2] for k, d in got.collect())
    assert _one(spark, dates.period_to_date(F.col("p")), p="Enero 2025") == "31-01-2025"
    assert _one(spark, dates.period_to_date(F.col("p")), p="05/03/2025") == "05-03-2025"
    assert _one(spark, dates.period_of_dated_name(F.col("p")), p="liq_20250210.pdf") == "28-02-2025"
    assert _one(spark, dates.block_date(F.col("p")), p="01/02/2025 F. Pres 03/02/2025 el día 04/02/2025 05/02/2025") == "03/02/2025"


def test_json(spark):
    assert _one(spark, F.to_json(jsontext.parse(F.col("t"))), t='x {"a":[1,2,],} y') == '{"a":[1,2]}'
    assert _one(spark, jsontext.parse(F.col("t")).isNull(), t="no json") is True


def test_text(spark):
    assert _one(spark, text.clean_label(F.col("t")), t="Arancel Tj.Crédito 1,80 % $ 18,00") == "ARANCEL TJ.CR DITO %"
    assert _one(spark, text.provider_key(F.col("t")), t="FACTURA ACME SA 01-02 0001-00012345") == "ACME SA"
    assert _one(spark, text.voucher_token(F.col("t")), t="ACME 0001-00012345") == "0001-00012345"
    assert _one(spark, text.last_number(F.col("t")), t="IVA 21,00% $ 3,78") == "3,78"
    assert _one(spark, text.norm_path(F.col("t")), t='"C:\\Datos/Ventas\\\\"') == "c:\\datos\\ventas"
    assert _one(spark, text.truncate_concept(F.col("t")), t="a " * 40) == ("a " * 25).rstrip()
    assert _one(spark, text.strip_accents(F.col("t")), t="Ñandú e\u0301") == "Nandu e"
    assert _one(spark, F.to_json(classify.detail_columns(F.array(*map(F.lit, ["Código", "Detalle", "Dto.", "Bonif.", "P. Total", "???"])))), t="x") == '["Codigo_Articulo","% Dto1","Total"]'
    assert _one(spark, text.unquote(F.col("t")), t="'a b'") == "a b"


def test_cards_and_banks(spark):
    assert _one(spark, classify.card_of_text(F.col("t")), t="paga american  express") == "TARJETA AMEX"
    assert _one(spark, classify.card_of_name(F.col("t")), t="liq_mastercard.pdf") == "TARJETA MASTERCARD"
    assert _one(spark, classify.is_generic_card(F.col("t")), t="Tarjeta de Crédito x") is True
    assert _one(spark, classify.bank_label(F.col("t")), t="Banco de la Nación") == "BANCO NACION"
    assert _one(spark, F.to_json(classify.auto_tuning(F.col("n"), "settlement")), n=5) == '{"tiles":4,"chunk":4}'


def test_number_helpers(spark):
    assert _one(spark, numbers.implied_price(F.lit(100.0), F.lit(4.0), F.lit(None), F.col("x")), x=20.0) == 25.0
    assert _one(spark, numbers.implied_price(F.lit(100.0), F.lit(4.0), F.lit(1), F.col("x")), x=25.1) == 25.1
    assert _one(spark, numbers.vat_or_theory(F.lit(100.0), F.col("x")), x=20.0) == 21.0
    assert _one(spark, numbers.deviates(F.col("x"), F.lit(-5.0), 0.03), x=9.0) is False


def test_accents_of_all_scripts(spark):
    """Every assigned code point, alone and between letters, against canonical decomposition without marks."""
    chars = [chr(c) for c in range(1, sys.maxunicode + 1) if unicodedata.category(chr(c)) not in ("Cs", "Cn", "Co")]
    rows = [(k, f"a{c}b") for k, c in enumerate(chars)] + [(-1, "Чёрный й ΐ ά 한국어 각 Ñandú"), (-2, ""), (-3, None)]
    plain = lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")
    got = {r.k: r.t for r in spark.createDataFrame(rows, "k int, t string").select("k", text.strip_accents(F.col("t")).alias("t")).collect()}
    wrong = [(k, t) for k, t in rows if got[k] != plain(t)]
    assert not wrong, wrong[:20]
