"""Sinks: ledgers as text, control sheets as tab-separated files, documents as JSON, quarantine and the status ledger.

Each writes a folder in parallel, one row or file per document; nothing is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_control
from ..operators.frames import ordered_columns


def write_texts(texts: DataFrame, path: str, text: str = "text", by: str = "doc") -> None:
    """One text per document, in folders by document."""
    texts.select(by, F.col(text).alias("value")).write.mode("overwrite").partitionBy(by).text(path)


def write_sheet(sheet: DataFrame, path: str, order: list, line: str = "LINEA") -> None:
    """A tab-separated sheet with numbered lines and a header; tabs and newlines in its cells become blanks.

    A sheet is a report of a few rows per day or concept; it is ordered over all of them.
    """
    texts = [c for c, kind in sheet.dtypes if kind == "string"]
    rows = sheet.withColumns({c: clean_control(F.col(f"`{c}`")) for c in texts}).withColumn(line, F.row_number().over(Window.orderBy(*order)))
    rows.select(line, *[F.col(f"`{c}`") for c in sheet.columns]).coalesce(1).sortWithinPartitions(line).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_documents(documents: DataFrame, path: str) -> None:
    """One JSON object per line; fields that are null are left out."""
    documents.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def split_quarantine(parsed: DataFrame, bad: str = "bad") -> tuple[DataFrame, DataFrame]:
    """Rows that could be parsed, and the raw rows that couldn't."""
    return parsed.where(~F.col(bad)), parsed.where(F.col(bad))


def append_status(entries: DataFrame, path: str, ts: str = "ts") -> None:
    """Append entries to the status ledger, by day."""
    entries.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").parquet(path)


def sheet_columns(rows: DataFrame, label: str, preferred: list[str]) -> list[str]:
    """Labels that occur, preferred ones first; there are as many as a settlement has kinds of lines."""
    found = rows.agg(ordered_columns(F.collect_set(label), preferred).alias("c")).first()
    return list(found["c"] or [])
