"""Steps that had to grow no faster than the input."""

from cuadra import document_queries, stream_queries
from cuadra.plans import invoice, settlement
from cuadra.queries import ORACLE_SQL, QUERIES


def test_merging_makes_no_row_of_each_field(spark):
    text = '{"CAB":{"Nombre":"%s","X":null},"ROWS":[{"Total":"%s"}],"TOTALES":{"Total":"%s"},"meta":{"totales_raw":"%s"}}'
    pages = [("1", 2, text % ("B", 2, " ", "z")), ("1", 1, text % ("", 1, "5", "y")), ("2", 1, "nada"), ("1", 3, text % ("C", 3, "6", ""))]
    docs = invoice.merge(invoice.normalize(spark.createDataFrame(pages, "doc string, page_no int, text string")))
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    (d,) = docs.collect()
    assert (d.CAB["Nombre"], d.CAB["X"], d.CAB["CAE"], d.TOTALES["Total"], d.meta["totales_raw"]) == ("B", "", "", "6", "z")
    assert [r["Total"] for r in d.rows] == ["1", "2", "3"]


def test_batches_of_several_files(spark, sf_dir, same_as_sql, monkeypatch):
    monkeypatch.setattr(stream_queries, "FILE_LINES", 500)
    assert same_as_sql(QUERIES["streamed_blocks"](spark, sf_dir), ORACLE_SQL["streamed_blocks"], sf_dir) > 0


def _pages(spark, n=40):
    text = "BANCO NACION\n\nVentas c/descuento contado+  $ 1%d,00\nARANCEL- $ 1,00\nIMPORTE NETO DE PAGOS $ 9,00\notra"
    return spark.createDataFrame([(str(k % 4), "d.pdf", k, text % (k % 3)) for k in range(n)], "doc string, file string, page_no int, text string")


def test_anchored_blocks_are_dealt_once_and_stay_within_their_pages(spark):
    blocks = settlement.anchored_blocks(_pages(spark))
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "collect_list" not in plan
    assert {(r.doc, r.label, r.amount) for r in blocks.where("label = 'VENTAS C/DESCUENTO CONTADO'").collect()} == {(str(d), "VENTAS C/DESCUENTO CONTADO", 10.0 + k) for d in range(4) for k in range(3)}


def test_tasks_order_a_bounded_number_of_pages(spark, monkeypatch):
    monkeypatch.setattr(settlement, "PAGES", 5)
    blocks = settlement.sequential_blocks(_pages(spark))
    assert "hashpartitioning(doc#" in (plan := blocks._jdf.queryExecution().executedPlan().toString()) and ", 8), REPARTITION_BY_NUM" in plan
    assert blocks.count() == 120


def test_banks_of_headers_are_detected_once(spark, sf_dir, same_as_sql):
    headers = document_queries.bank_headers(spark, sf_dir)
    assert "_stripped" not in headers._jdf.queryExecution().optimizedPlan().toString()
    assert same_as_sql(headers, ORACLE_SQL["bank_headers"], sf_dir) > 0
