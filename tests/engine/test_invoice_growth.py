"""Invoices are merged, deduplicated and checked within a row."""

import json

from cuadra import document_queries
from cuadra.plans import invoice
from cuadra.queries import ORACLE_SQL, QUERIES

assert document_queries


def test_invoices_are_shuffled_as_lines_only_and_merged_and_checked_within_a_row(spark, sf_dir, same_as_sql):
    for name, dealt in (("invoice_plan", 2), ("invoice_detail_rows", 2)):
        df = QUERIES[name](spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= dealt and "Window" not in plan and "invoices-" not in plan
        assert same_as_sql(df, ORACLE_SQL[name], sf_dir) > 0


def test_rows_kept_within_a_document(spark):
    row = lambda code, total, more="": {"Codigo_Articulo": code, "Total": total, "UD": more}
    rows = [row("b", "1,50", "first"), row("", " "), row("a", "2"), row(" b ", "1,50"), {"UD": "u"}, row("a", "2,00"), row("b", "1,50")]
    pages = [("i", 2, json.dumps({"ROWS": [row("a", "2"), row("c", "x")]})), ("i", 1, json.dumps({"ROWS": rows, "CAB": {"Nombre": "z"}})), ("k", 1, '{"ROWS":[{"UD":"u"}]}')]
    answers = spark.createDataFrame(pages, "doc string, page_no int, text string")
    docs = invoice.documents(answers)
    assert sorted(map(str, docs.collect())) == sorted(map(str, invoice.merge(invoice.normalize(answers)).select(docs.columns).collect()))
    kept = invoice.detail_rows(docs)
    assert [(r.doc, r.pos, r.Codigo_Articulo, r.Total, r.UD) for r in kept.orderBy("pos").collect()] == [("i", 0, "b", "1,50", "first"), ("i", 2, "a", "2", ""), ("i", 5, "a", "2,00", ""), ("i", 8, "c", "x", "")]
    columns = ["doc", "n_rows", "row_total", "target", "expected", "deviation", "flagged", "good"]
    within, joined = [df.select(columns).orderBy("doc").collect() for df in (invoice.checked_within(docs), invoice.checked(docs, kept))]
    assert within == joined and [(r.n_rows, r.row_total) for r in within] == [(4, 5.5), (0, None)]
