import os
import time

from pyspark.sql import functions as F

from cuadra.operators.ingest import discover
from cuadra.sources import documents, sinks
from cuadra.streaming import agent


def test_pages_cells_and_answers(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one\x0ctwo\x0c")
    (tmp_path / "b.pdf").write_bytes(b"!")

    def read(content):
        if content == b"!":
            raise ValueError("broken")
        return content.decode().split("\x0c")

    pages = documents.page_texts(spark, str(tmp_path), read)
    assert [tuple(r) for r in pages.orderBy("page_no").collect()] == [("a.pdf", 1, "one"), ("a.pdf", 2, "two"), ("a.pdf", 3, "")]
    files = spark.createDataFrame([("a.pdf",), ("b.pdf",)], "file string")
    assert {tuple(r) for r in documents.page_counts(files, pages).collect()} == {("a.pdf", 3), ("b.pdf", 1)}
    cells = documents.sheet_cells(spark, str(tmp_path), lambda c: [("s", [1, " x ", None])] * 3, max_rows=2).where("file = 'a.pdf'").collect()
    assert [(r.row_no, r.cells, r.nums) for r in cells] == [(k, ["1", "x", ""], [1.0, None, None]) for k in (1, 2)]

    def call(request):
        if request == "bad":
            raise RuntimeError("413 too large")
        return request.upper()

    units = spark.createDataFrame([("d", 1, "hi"), ("d", 2, "bad")], "doc string, unit_no int, request string")
    got = documents.model_answers(units, call).withColumn("large", documents.is_too_large(F.col("error"))).orderBy("unit_no").collect()
    assert [(r.text, r.large) for r in got] == [("HI", False), (None, True)]
    smaller = documents.retry_smaller(units, documents.model_answers(units, call), call, lambda u: u.withColumn("request", F.explode(F.split("request", "a"))))
    assert sorted(r.text for r in smaller.collect()) == ["B", "D", "HI"]
    assert documents.prompt(spark, None, "say {x}", "{y}", "use {y}") == "use {y}\nsay {x}"
    assert len(documents.signature("k", "1", "n", "{}")) == 64


def test_sinks(spark, tmp_path):
    to = lambda n: str(tmp_path / n)
    sinks.write_texts(spark.createDataFrame([("a", "x\ny\n")], "doc string, text string"), to("t"))
    assert {r.value for r in spark.read.text(to("t")).collect()} >= {"x", "y"}
    sinks.write_sheet(spark.createDataFrame([("b\tc", 2.0), ("a", 1.0)], "name string, v double"), to("s"), ["v"])
    got = spark.read.option("sep", "\t").option("header", True).csv(to("s")).collect()
    assert [tuple(r) for r in got] == [("1", "a", "1.0"), ("2", "b c", "2.0")]
    good, bad = sinks.split_quarantine(spark.createDataFrame([(1, True), (2, False)], "k int, bad boolean"))
    sinks.write_documents(good, to("j"))
    assert spark.read.json(to("j")).count() == 1 and bad.first().k == 1
    sinks.append_status(spark.sql("select 'f' as name, 'OK' as status, current_timestamp() as ts"), to("l"))
    assert spark.read.parquet(to("l")).first().status == "OK"
    assert sinks.sheet_columns(spark.createDataFrame([("z",), ("b",), ("p",)], "l string"), "l", ["p", "q"]) == ["p", "b", "z"]


def test_stream_meets_files_again(spark, tmp_path):
    folder, ledger = tmp_path / "in", str(tmp_path / "ledger")
    os.makedirs(folder)
    (folder / "old.pdf").write_bytes(b"x")
    past = time.time() - 3600
    os.utime(folder / "old.pdf", (past, past))
    (folder / "new.pdf").write_bytes(b"x")
    assert [r.name for r in discover(spark, str(folder), [".PDF"]).collect()] == ["new.pdf", "old.pdf"]

    def process(groups):
        return groups.select("document", F.lit("OK").alias("status"), F.lit("").alias("message"))

    count = lambda: spark.read.schema("name string").parquet(ledger).count()
    query = agent.watch(spark, str(folder), ["pdf"], ledger, str(tmp_path / "c"), process, interval="1 second")
    try:
        deadline = time.time() + 60
        while time.time() < deadline and count() < 1:
            time.sleep(1)
        os.utime(folder / "new.pdf", (past, past))
        while time.time() < deadline and count() < 2:
            time.sleep(1)
        time.sleep(3)
    finally:
        query.stop()
    assert sorted(r.name for r in spark.read.parquet(ledger).collect()) == ["new.pdf", "old.pdf"]


def test_streamed_blocks(spark, tmp_path):
    kind = "doc string, pos long, label string, amount double, terminal boolean"
    rows = [("d", 1, "a", 1.0, False), ("d", 2, "a", 2.0, False), ("d", 3, "net", 3.0, True), ("d", 4, "a", 9.0, False), ("e", 1, "net", 0.0, True)]
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "in"))
    lines = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    q = agent.closed_blocks(lines).writeStream.format("memory").queryName("blocks").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {tuple(r) for r in spark.table("blocks").collect()} == {("d", 0, "a", 2.0), ("d", 0, "net", 3.0)}


def test_counts_and_connections(spark):
    import pytest

    from cuadra.operators.ingest import MOST_FILES, checked_count
    from cuadra.sources.documents import sql_server

    assert checked_count(spark.range(5), MOST_FILES["compras"]).count() == 5
    for n in (0, 6):
        with pytest.raises(ValueError):
            checked_count(spark.range(n), MOST_FILES["compras"])
    assert sql_server("s", "d", "u", "p")["user"] == "u" and sql_server("s", "d", "u")["url"].endswith("integratedSecurity=true")
    with pytest.raises(ValueError):
        sql_server("", "d")


def test_rows_are_numbered_in_each_sheet(spark, tmp_path):
    from cuadra.sources.documents import sheet_cells

    (tmp_path / "a.xls").write_bytes(b"x")
    read = lambda _: [("one", [1, "a"]), ("one", [None, " b "]), ("two", ["c"]), ("two", ["d"]), ("two", ["e"])]
    got = [(r.sheet_name, r.row_no, list(r.cells)) for r in sheet_cells(spark, str(tmp_path), read).orderBy("sheet_name", "row_no").collect()]
    assert got == [("one", 1, ["1", "a"]), ("one", 2, ["", "b"]), ("two", 1, ["c"]), ("two", 2, ["d"]), ("two", 3, ["e"])]
    assert sheet_cells(spark, str(tmp_path), read, max_rows=1, max_cells=1).count() == 2
