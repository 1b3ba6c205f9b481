"""Order-sensitive operators: dedupe, merge, blocks, line windows, carried labels.

Order is always a column of the data, never the order in which rows happen to arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import once


def keep_first(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key, by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def filled(value: Column) -> Column:
    """The value where it is neither null nor blank."""
    return F.when(value.isNotNull() & (F.trim(value.cast("string")) != ""), value)


def first_nonempty(value: Column, order: Column) -> Column:
    """Aggregate: the first value that isn't blank."""
    return F.min_by(filled(value), F.when(filled(value).isNotNull(), order))


def last_nonempty(value: Column, order: Column) -> Column:
    return F.max_by(filled(value), F.when(filled(value).isNotNull(), order))


def blocks_until(rows: DataFrame, by: list, order: list, ends: Column) -> DataFrame:
    """Number the blocks that rows with ``ends`` close: columns ``block`` and ``closed``. Rows after the last end are open."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_end", F.coalesce(ends, F.lit(False)).cast("int"))
    rows = rows.withColumn("block", F.coalesce(F.sum("_end").over(before), F.lit(0)))
    return rows.withColumn("closed", F.col("block") < F.sum("_end").over(Window.partitionBy(*by))).drop("_end")


def block_amounts(rows: DataFrame, by: list, order: str, label: str, amount: str, terminal: str) -> DataFrame:
    """Closed blocks, one row for each label with its last amount. Rows without a label or a positive amount don't count; a
    terminal label closes the block."""
    kept = rows.where(F.col(label).isNotNull() & (F.col(amount) > 0))
    blocks = blocks_until(kept, by, [order], F.col(label) == terminal).where("closed")
    return blocks.groupBy(*by, "block", label).agg(F.max_by(amount, order).alias(amount))


def line_windows(rows: DataFrame, by: list, order: list, line: str, anchor: Column, before: int, after: int) -> DataFrame:
    """For each anchor line, the lines around it as an array ``window``."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = rows.withColumn("_anchor", anchor).withColumn("window", F.collect_list(line).over(w.rowsBetween(-before, after)))
    return rows.where("_anchor").drop("_anchor")


def crop(lines: Column, start: str, end: str) -> Column:
    """Lines from the first that matches ``start`` to the first that matches ``end``; null where there is no end, or it comes
    first. Without a start before it, from the first line."""
    at = lambda x, pattern: F.array_position(F.transform(x, lambda line: line.rlike(pattern)), F.lit(True)).cast("int")

    def between(p: Column) -> Column:
        x, b = p["x"], p["b"]
        a = F.when((p["a"] == 0) | (p["a"] > b), F.lit(1)).otherwise(p["a"])
        return F.when(b > 0, F.slice(x, a, b - a + 1))

    return once(lines, lambda x: once(F.struct(x.alias("x"), at(x, start).alias("a"), at(x, end).alias("b")), between))


def carry_forward(rows: DataFrame, by: list, order: list, label: Column, name: str) -> DataFrame:
    """The last label that isn't null, up to each row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(label, ignorenulls=True).over(w))


def cut_at_blank_streak(rows: DataFrame, by: list, order: str, blank: Column, streak: int = 120, after: int = 100) -> DataFrame:
    """Rows before the place where ``streak`` blank rows in a row are reached, past ``after`` rows."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = rows.withColumn("_blank", blank).withColumn("_row", F.row_number().over(w))
    rows = rows.withColumn("_solid", F.max(F.when(~F.col("_blank"), F.col("_row"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    reached = F.col("_blank") & (F.col("_row") - F.coalesce("_solid", F.lit(0)) >= streak) & (F.col("_row") > after)
    rows = rows.withColumn("_cut", F.min(F.when(reached, F.col("_row"))).over(Window.partitionBy(*by)))
    return rows.where("_cut is null or _row < _cut").drop("_blank", "_row", "_solid", "_cut")


def numbered(rows: DataFrame, by: list, order: list, name: str = "line") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def neighbour(rows: DataFrame, by: list, order: list, text: str, n: int = 800, name: str = "next_head") -> DataFrame:
    """The first ``n`` characters of the next row's text."""
    return rows.withColumn(name, F.lead(F.left(F.col(text), F.lit(n))).over(Window.partitionBy(*by).orderBy(*order)))


def before_marker(rows: DataFrame, by: list, order: list, marker: Column, name: str = "after_marker") -> DataFrame:
    """Flag the marker line and all after it."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.max(F.coalesce(marker, F.lit(False))).over(w))


def drop_covered(rows: DataFrame, by: list, signal: Column, covered: Column) -> DataFrame:
    """Drop ``covered`` rows where any row of the group gives the ``signal``."""
    w = Window.partitionBy(*by)
    return rows.withColumn("_s", F.max(F.coalesce(signal, F.lit(False))).over(w)).where(~(F.col("_s") & F.coalesce(covered, F.lit(False)))).drop("_s")


def merge_pages(pages: DataFrame, by: list, order: str, first: list[str], last: list[str], rows: str | None = None) -> DataFrame:
    """One row per document: first value that isn't blank of ``first`` columns, last one of ``last``, and the arrays of ``rows``
    joined in page order."""
    out = [first_nonempty(F.col(c), F.col(order)).alias(c) for c in first] + [last_nonempty(F.col(c), F.col(order)).alias(c) for c in last]
    if rows:
        parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(rows).alias("r"))))
        out.append(F.flatten(F.transform(parts, lambda p: p["r"])).alias(rows))
    return pages.groupBy(*by).agg(*out)


def ordered_columns(present: Column, preferred: list[str]) -> Column:
    """Labels that are present: preferred ones in their order, then the rest by name."""
    return F.concat(F.array_intersect(F.array(*map(F.lit, preferred)), present), F.array_sort(F.array_except(present, F.array(*map(F.lit, preferred)))))
