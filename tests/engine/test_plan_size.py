"""Plans stay small: the driver keeps the text of a plan, and of each of its changes while it runs."""

from pyspark.sql import functions as F

from cuadra.functions import text


def _size(df):
    return len(df._jdf.queryExecution().toString())


def test_normalizing_doesnt_write_tables_of_letters_into_plans(spark):
    one = spark.range(1).select(F.concat(F.lit("Comisión  "), F.col("id").cast("string")).alias("t"))
    df = one.select(text.norm_text(F.col("t")).alias("n"), text.norm_cells(F.array("t", F.lit(None), F.lit(" é "))).alias("c"))
    assert _size(df) < 5000
    assert df.first() == ("COMISION 0", ["COMISION 0", "", "E"])
    assert [text.norm_word(w) for w in ("Débito", " a\t b ")] == ["DEBITO", "A B"]


def test_cells_of_null_and_empty_rows(spark):
    rows = [(1, ["á", None, "b"]), (2, None), (3, []), (4, ["ñ\t x"]), (5, [None])]
    got = {r.k: r.c for r in spark.createDataFrame(rows, "k int, c array<string>").coalesce(1).select("k", text.norm_cells(F.col("c")).alias("c")).collect()}
    assert got == {1: ["A", "", "B"], 2: None, 3: [], 4: ["N X"], 5: [""]}


def test_settlement_ledger_doesnt_repeat_its_facts(spark):
    from cuadra.plans import settlement

    pages = spark.createDataFrame([("1", "a.pdf", 1, "BANCO NACION\nVENTAS C/DESCUENTO CONTADO+ $ 10,00\nIMPORTE NETO DE PAGOS $ 10,00")], "doc string, file string, page_no int, text string")
    df = settlement.ledger(pages, spark.createDataFrame([], "doc string, text string"))
    assert _size(df) < 600_000
    assert [(r.category, float(r.amount)) for r in df.orderBy("ord").collect()] == [(settlement.SALES, 10.0), (settlement.NET, -10.0)]
