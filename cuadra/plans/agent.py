"""The incremental run over a folder: discover, skip what is done, wait for what is unstable, group, process, record."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ingest import group_documents, pending, retained, stable


def plan_run(files: DataFrame, ledger: DataFrame, now: Column, force: bool = False, stable_seconds: int = 120, days: int = 7) -> DataFrame:
    """``files`` with ``outcome``: SKIP (done before), NOT_READY (empty or too young) or READY."""
    todo = pending(files, retained(ledger, now, days), force=force).select("name").withColumn("_todo", F.lit(True))
    out = files.join(todo, "name", "left")
    ready = stable(F.col("length"), F.col("modificationTime"), now, stable_seconds)
    return out.withColumn("outcome", F.when(F.col("_todo").isNull(), "SKIP").when(~ready, "NOT_READY").otherwise("READY")).drop("_todo")


def run(files: DataFrame, ledger: DataFrame, process: Callable[[DataFrame], DataFrame], now: Column, **options) -> DataFrame:
    """Entries for the ledger: name, status, ts, message. ``process`` takes groups (document, members, n) and returns
    document, status, message."""
    ready = plan_run(files, ledger, now, **options).where("outcome = 'READY'")
    groups = group_documents(ready)
    done = process(groups).select("document", "status", "message")
    return groups.join(done, "document").select(F.explode("members.name").alias("name"), "status", now.alias("ts"), "message")
