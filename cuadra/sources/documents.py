"""Sources that need code outside Spark: page text, sheet cells and model answers, with injectable readers.

Readers run in the tasks that hold the files; each yields rows, so nothing is gathered.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import removed, written

#: Fixed: MIME types by extension.
MIME = {"pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg"}


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).select(F.substring_index("path", "/", -1).alias("file"), "content")


def page_texts(spark: SparkSession, folder: str, read_pages: Callable[[bytes], Iterable[str]]) -> DataFrame:
    """file, page_no (from 1), text. Files that can't be read give no rows here, and one in ``unread``; empty pages give empty texts."""
    return _read_pages(spark, folder, read_pages).where("error is null").drop("error")


def unread(spark: SparkSession, folder: str, read_pages: Callable[[bytes], Iterable[str]]) -> DataFrame:
    """file and error of the files that can't be read, for the quarantine."""
    return _read_pages(spark, folder, read_pages).where("error is not null").select("file", "error")


def _read_pages(spark: SparkSession, folder: str, read_pages: Callable[[bytes], Iterable[str]]) -> DataFrame:
    def task(it):
        for pdf in it:
            rows = []
            for name, content in zip(pdf.file, pdf.content, strict=True):
                try:
                    rows += [(name, k, t or "", None) for k, t in enumerate(read_pages(bytes(content)), 1)]
                except Exception as e:
                    rows.append((name, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["file", "page_no", "text", "error"]).astype({"page_no": "Int32"})

    return _files(spark, folder).mapInPandas(task, "file string, page_no int, text string, error string")


def page_counts(files: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages of each file, 1 where none could be read."""
    return files.join(pages.groupBy("file").agg(F.count("*").alias("n")), "file", "left").select("file", F.greatest(F.coalesce("n", F.lit(1)), F.lit(1)).alias("pages"))


def sheet_cells(spark: SparkSession, folder: str, read_rows: Callable[[bytes], Iterable[tuple[str, list]]], max_rows: int | None = None, max_cells: int | None = None) -> DataFrame:
    """file, sheet_name, row_no (from 1 in each sheet), cells (text) and nums (numbers among them). All rows and cells are read unless
    ``max_rows`` and ``max_cells`` of a sheet are given; the rows of a sheet follow each other."""

    def task(it):
        for pdf in it:
            rows = []
            for name, content in zip(pdf.file, pdf.content, strict=True):
                last, k = None, 0
                for sheet, values in read_rows(bytes(content)):
                    last, k = sheet, k + 1 if sheet == last else 1
                    if max_rows is not None and k > max_rows:
                        continue
                    values = list(values)[:max_cells]
                    number = [float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None for v in values]
                    rows.append((name, sheet, k, ["" if v is None else str(v).strip() for v in values], number))
            yield pd.DataFrame(rows, columns=["file", "sheet_name", "row_no", "cells", "nums"])

    return _files(spark, folder).mapInPandas(task, "file string, sheet_name string, row_no int, cells array<string>, nums array<double>")


def content_block(name: Column, content: Column) -> Column:
    """A data URL by the file's extension; an unsupported one is an error."""
    ext = F.lower(F.substring_index(name, ".", -1))
    mime = F.try_element_at(F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair]), ext)
    return F.when(mime.isNull(), F.raise_error(F.concat(F.lit("unsupported extension: "), ext))).otherwise(F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content)))


def signature(secret: str, timestamp: str, nonce: str, body: str) -> str:
    """HMAC-SHA256 over timestamp.nonce.body, in hexadecimal."""
    return hmac.new(secret.encode(), f"{timestamp}.{nonce}.{body}".encode(), hashlib.sha256).hexdigest()


def model_answers(units: DataFrame, call: Callable[[str], str]) -> DataFrame:
    """``units`` (doc, unit_no, request) to doc, unit_no, text, error. An error stays with its unit, for a later pass."""

    def task(it):
        for pdf in it:
            rows = []
            for doc, unit, request in zip(pdf.doc, pdf.unit_no, pdf.request, strict=True):
                try:
                    rows.append((doc, unit, call(request), None))
                except Exception as e:
                    rows.append((doc, unit, None, str(e)))
            yield pd.DataFrame(rows, columns=["doc", "unit_no", "text", "error"])

    return units.select("doc", "unit_no", "request").mapInPandas(task, "doc string, unit_no int, text string, error string")


def is_too_large(error: Column) -> Column:
    """Whether a request failed for its size, so that smaller units can help."""
    t = F.lower(F.coalesce(error, F.lit("")))
    return F.contains(t, F.lit("too large")) | F.contains(t, F.lit("413")) | F.contains(t, F.lit("request_too_large")) | F.contains(t, F.lit("payload"))


def retry_smaller(units: DataFrame, answers: DataFrame, call: Callable[[str], str], split: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Ask again, in smaller units, where a request was too large. ``split`` takes the units and returns smaller ones."""
    large = answers.where(is_too_large(F.col("error"))).select("doc", "unit_no")
    again = model_answers(split(units.join(large, ["doc", "unit_no"], "left_semi")), call)
    return answers.join(large, ["doc", "unit_no"], "left_anti").unionByName(again)


def answers_by_halves(ranges: DataFrame, ask: Callable[[DataFrame], DataFrame], most_rounds: int = 32) -> tuple[DataFrame, list[str]]:
    """Ask for ranges of pages (doc, first, last); where one is too large, ask for its halves, until they fit or are one page.

    ``ask`` takes ranges and returns doc, first, last, text and error for each. Every round's answers are written once, in the shared
    folder, so no request is made twice by a later round; a range of n pages takes at most 1 + log2(n) rounds. Returns doc, first,
    last, text, error and round, whose ranges cover those that were asked for, each page once, and the folders, which can go when the
    answers have been used. A single page that is too large keeps its error.
    """
    spark, done, folders = ranges.sparkSession, [], []
    pending = ranges.select("doc", "first", "last")
    for k in range(most_rounds):
        got, at = written(ask(pending).select("doc", "first", "last", "text", "error"), "answers")
        folders.append(at)
        halved = is_too_large(F.col("error")) & (F.col("last") > F.col("first"))
        done.append(got.where(~halved).withColumn("round", F.lit(k + 1)))
        large = got.where(halved)
        if large.isEmpty():
            return functools.reduce(DataFrame.unionByName, done), folders
        middle = F.expr("first + (last - first) div 2")
        pending = large.select("doc", F.inline(F.array(F.struct(F.col("first"), middle.alias("last")), F.struct((middle + 1).alias("first"), F.col("last")))))
        pending = pending.select("doc", F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"))
    removed(spark, *folders)
    raise ValueError(f"ranges are too large after {most_rounds} rounds")


def prompt(spark: SparkSession, path: str | None, default: str, token: str, guard: str) -> str:
    """The text of a prompt's file, else the default; the guard goes before it where it lacks the token."""
    text = default if path is None else spark.read.text(path, wholetext=True).first()[0]
    return text if token in text else f"{guard}\n{text}"


def source_name(blocks: Column) -> Column:
    """The first file name among content blocks that isn't blank."""
    return F.get(F.filter(F.transform(blocks, lambda b: b["filename"]), lambda n: F.trim(F.coalesce(n, F.lit(""))) != ""), 0)


def clients_table(spark: SparkSession, url: str, table: str, id_column: str, route: str, **options: str) -> DataFrame:
    """Clients and routes of a database, with the filter pushed to it."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load().select(id_column, route).where(F.col(route).isNotNull())


def sql_server(server: str, database: str, user: str = "", password: str = "") -> dict[str, str]:
    """JDBC options for ``clients_table``: with a user and password where both are given, else by the account that runs Spark."""
    if not server or not database:
        raise ValueError("a server and a database are needed")
    url = f"jdbc:sqlserver://{server};databaseName={database};trustServerCertificate=true"
    return {"url": url, "user": user, "password": password} if user and password else {"url": f"{url};integratedSecurity=true"}
