"""Cells of statements are made or read once, however many steps use them."""

import pytest
from pyspark.sql import functions as F

from cuadra import document_queries
from cuadra.operators import classify
from cuadra.plans import bank
from cuadra.queries import ORACLE_SQL, QUERIES
from cuadra.sources import sheets


@pytest.fixture
def counted(spark, sf_dir):
    """Cells of the queries' statements, and how many rows of them have been made."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(file):
        made.add(1)
        return file

    cells = document_queries._cells(spark, sf_dir)
    return cells.withColumn("file", seen.asNondeterministic()("file")), made, cells.count()


def test_statement_rows_make_their_cells_once(spark, sf_dir, counted):
    cells, made, n = counted
    assert bank.statement_rows(cells).count() == QUERIES["bank_statement_rows"](spark, sf_dir).count() > 0
    assert made.value == n


def test_names_of_files_and_sheets_are_normalized_once_for_each_sheet(spark, sf_dir):
    plan = bank.detect_bank(document_queries._cells(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.rindex("Aggregate [file#") :]
    assert "_single_spaced_cells(" in below and "_single_spaced(" not in below and "_single_spaced(" in plan


def test_control_sheets_classify_their_rows_once(spark, sf_dir, same_as_sql):
    df = document_queries.bank_control_sheets(spark, sf_dir)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "EvalPython" not in plan
    assert same_as_sql(df, ORACLE_SQL["bank_control_sheets"], sf_dir) > 0


def test_files_of_statements_make_their_cells_once(spark, tmp_path, counted):
    cells, made, n = counted
    rules, out = classify.read_rules(spark)
    bank.write_statements(cells, rules, out, F.lit("2020-01-01").cast("date"), str(tmp_path / "out"))
    assert made.value == n and len(list((tmp_path / "out").glob("*.log"))) > 0


def test_workbooks_are_dealt_to_all_cores(spark, tmp_path):
    day = [[45000, "1", "c", -1.5]]

    def read(data):
        return [("Hoja1 - Table 1", k, r) for k, r in enumerate([["Fecha", "Comprobante", "Concepto", "Importe"], *day * 3], 1)]

    for k in range(12):
        (tmp_path / f"{k}.xls").write_bytes(b"x" * 10)
    cells = sheets.sheet_rows(spark, str(tmp_path), read=read)
    cores = spark.sparkContext.defaultParallelism
    parts = sheets.SheetReader({"path": str(tmp_path), "tasks": str(cores)}, read).partitions()
    assert len(parts) >= cores and sorted(p for part in parts for p in part.paths) == sorted(str(tmp_path / f"{k}.xls") for k in range(12))
    rows = bank.statement_rows(cells).collect()
    assert len(rows) == 36 and {(r.bank, r.date, r.amount) for r in rows} == {("BNA", "15/03/2023", -1.5)}
