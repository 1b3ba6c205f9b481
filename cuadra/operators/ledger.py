"""Ledgers that close to zero: sums, contra and residual entries, control sheets, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import MONEY, close_to, deviates, money
from ..functions.text import truncate_concept
from .classify import NET, SALES


def sums_by(rows: DataFrame, keys: list, amount: str = "amount") -> DataFrame:
    """Decimals are summed, so the result doesn't depend on the order."""
    return rows.groupBy(*keys).agg(F.sum(money(F.col(amount))).cast(MONEY).alias(amount))


def with_contra(totals: DataFrame, by: list, contra: str, amount: str = "amount", category: str = "category") -> DataFrame:
    """Add the entry that balances all others of each document."""
    other = totals.where(F.col(category) != contra)
    entry = other.groupBy(*by).agg((-F.sum(amount)).cast(MONEY).alias(amount)).withColumn(category, F.lit(contra))
    return other.unionByName(entry.select(other.columns))


def with_residual(totals: DataFrame, by: list, residual: str = "OTROS", amount: str = "amount", category: str = "category") -> DataFrame:
    """Replace the residual by what is missing to zero; nothing where that is below a cent."""
    other = totals.where(F.col(category) != residual)
    gap = F.sum(amount)
    entry = other.groupBy(*by).agg(F.when(F.abs(gap) < 0.01, F.lit(0)).otherwise(-gap).cast(MONEY).alias(amount)).withColumn(category, F.lit(residual))
    return other.unionByName(entry.select(other.columns))


def filled_categories(totals: DataFrame, by: list, categories: list[str], amount: str = "amount", category: str = "category") -> DataFrame:
    """Every category of every document, in order (``ord``), 0 where it has no amount."""
    dim = F.posexplode(F.array(*map(F.lit, categories)))
    every = totals.select(*by).distinct().select(*by, dim.alias("ord", category)) if by else totals.sparkSession.range(1).select(dim.alias("ord", category))
    return every.join(totals, [*by, category], "left").withColumn(amount, F.coalesce(F.col(amount), F.lit(0)).cast(MONEY))


def concept_control(rows: DataFrame, keys: list, amount: str = "amount", order: str | None = None) -> DataFrame:
    """Count and sum per concept, by falling absolute sum; ties by first appearance in ``order``, or by key where none is given."""
    first = [F.min(order).alias("_first")] if order else []
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(money(F.col(amount))).cast(MONEY).alias(amount), *first)
    return out.orderBy(F.abs(amount).desc(), *(["_first"] if order else []), *keys).drop("_first")


def top_unknown(rows: DataFrame, keys: list, n: int = 20, order: str | None = None) -> DataFrame:
    """The ``n`` most frequent; ties by first appearance in ``order``, or by key where none is given."""
    first = [F.min(order).alias("_first")] if order else []
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), *first)
    return out.orderBy(F.desc("n"), *(["_first"] if order else []), *keys).drop("_first").limit(n)


def control_sheet(rows: DataFrame, row_keys: list, label: str, amount: str, labels: list[str], sales: str = SALES, net: str = NET, by: list | None = None) -> DataFrame:
    """A column for each label, the sum of charges, ``check`` = sales - (net + charges), and a TOTAL row (keys null), one for each
    ``by`` where given."""
    wide = rows.groupBy(*row_keys).pivot(label, labels).agg(F.sum(money(F.col(amount))))
    zero = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast(MONEY)
    wide = wide.select(*row_keys, *[zero(c).alias(c) for c in labels])
    by = by or []
    total = wide.groupBy(*by).agg(*[F.sum(f"`{c}`").cast(MONEY).alias(c) for c in labels])
    total = total.select(*[F.col(k) if k in by else F.lit(None).cast(wide.schema[k].dataType).alias(k) for k in row_keys], *[F.col(f"`{c}`") for c in labels])
    both = wide.unionByName(total)
    charges = [F.col(f"`{c}`") for c in labels if c not in (sales, net)]
    charge = sum(charges[1:], charges[0]) if charges else F.lit(0)
    both = both.withColumn("charges", charge.cast(MONEY))
    return both.withColumn("check", (F.col(f"`{sales}`") - (F.col(f"`{net}`") + F.col("charges"))).cast(MONEY))


def two_largest(amounts: Column) -> Column:
    """Total and net of a header: its two largest distinct amounts."""
    return F.slice(F.sort_array(F.array_distinct(amounts), False), 1, 2)


def validated(documents: DataFrame, total: Column, target: Column, limit: float = 0.03) -> DataFrame:
    """Flag documents whose rows don't add up to the stated total."""
    return documents.withColumn("deviation", F.try_divide(F.abs(total - target), target)).withColumn("flagged", deviates(total, target, limit))


def complete_or_all(blocks: DataFrame, by: list, sales: str, net: str, total_sales: str, total_net: str) -> DataFrame:
    """All blocks where their sums match the header's; else only blocks with both amounts, if that makes them match; else all.

    A header amount that is null matches anything.
    """
    w = Window.partitionBy(*by)
    whole = (F.coalesce(F.col(sales), F.lit(0)) > 0) & (F.coalesce(F.col(net), F.lit(0)) > 0)
    sums = lambda c, only: F.coalesce(F.sum(F.when(only, F.col(c))).over(w), F.lit(0))
    ok = lambda c, target, only: F.col(target).isNull() | close_to(sums(c, only), F.col(target))
    every = F.lit(True)
    out = blocks.withColumn("_whole", whole).withColumn("_all", ok(sales, total_sales, every) & ok(net, total_net, every)).withColumn("_some", ok(sales, total_sales, whole) & ok(net, total_net, whole) & F.max(whole).over(w))
    return out.where(F.col("_all") | ~F.col("_some") | F.col("_whole")).drop("_whole", "_all", "_some")


def honour_net(totals: DataFrame, by: list, header: str, label: str = "label", amount: str = "amount") -> DataFrame:
    """Where the header's net is more than 1 and 0.2 % off the rows' net, take it, and let sales be net plus charges.

    ``totals`` has a row for each label and the header's net in each.
    """
    w = Window.partitionBy(*by)
    is_net, is_sales = F.col(label) == NET, F.col(label) == SALES
    net = F.max(F.when(is_net, F.col(amount))).over(w)
    charges = F.sum(F.when(~is_net & ~is_sales, F.col(amount)).otherwise(0)).over(w)
    off = F.col(header).isNotNull() & net.isNotNull() & (F.abs(net - F.col(header)) > F.greatest(F.lit(1.0), F.col(header) * 0.002))
    value = F.when(off & is_net, F.col(header)).when(off & is_sales, F.col(header) + charges).otherwise(F.col(amount))
    return totals.withColumn("_v", value.cast(MONEY)).withColumn(amount, F.col("_v")).drop("_v")


def ledger_text(lines: DataFrame, by: list, header: str | None = None, category: str = "category", amount: str = "amount", order: str = "ord") -> DataFrame:
    """CONCEPTO|IMPORTE lines of each document as one text, in order, after the header where there is one."""
    line = F.concat(F.col(category), F.lit("|"), F.col(amount).cast(MONEY).cast("string"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"]), "\n")
    parts = lines.groupBy(*by).agg(body.alias("body"), *([F.first(header).alias("_h")] if header else []))
    return parts.select(*by, F.concat(*([F.coalesce("_h", F.lit(""))] if header else []), "body", F.lit("\n")).alias("text"))


def document_header(prefix: str, bank: Column, subject: Column, period: Column, short_bank: Column, short_subject: Column | None = None) -> Column:
    """The five lines before a ledger's entries: bank, subject, period, a concept of at most 50 characters and the titles."""
    words = [F.lit(prefix), period, *([] if short_subject is None else [short_subject]), short_bank]
    concept = truncate_concept(F.array_join(F.array(*[F.coalesce(w, F.lit("")) for w in words]), " "))
    lines = [F.trim(F.coalesce(x, F.lit(""))) for x in (bank, subject, period)] + [concept, F.lit("CONCEPTO|IMPORTE"), F.lit("")]
    return F.array_join(F.array(*lines), "\n")


def last_per_category(lines: DataFrame, by: list, category: str, amount: str, order: str) -> DataFrame:
    """A later line of a category replaces an earlier one."""
    return lines.groupBy(*by, category).agg(F.max_by(amount, order).alias(amount))


def run_counters(files: DataFrame, client: str, folder: str, outcome: str) -> DataFrame:
    """processed, skipped, errors and not_ready by folder, client and run, each with its result."""
    counts = [F.count_if(F.col(outcome) == value).alias(name) for value, name in (("OK", "processed"), ("SKIP", "skipped"), ("ERROR", "errors"), ("NOT_READY", "not_ready"))]
    return files.rollup(client, folder).agg(*counts).withColumn("result", F.when(F.col("errors") == 0, "OK").otherwise("ERROR"))
