"""The incremental run as a stream: each trigger lists the folder again, so unstable files are met again."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators.ingest import discover
from ..plans.agent import run
from .blocks import closed_blocks
from .lease import HOURS, Lease

__all__ = ["closed_blocks", "read_ledger", "record", "watch"]

ENTRIES = "name string, status string, ts timestamp, message string"
#: Entries of the ledger are in folders by day, by the stream that wrote them, and by its batch.
PARTS = "day date, stream string, batch long"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """name, status, ts, message, day, stream, batch; empty where nothing has been written."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    return spark.read.schema(f"{ENTRIES}, {PARTS}").parquet(path)


def record(spark: SparkSession, path: str, stream: str, batch: int, entries: Callable[[], DataFrame]) -> bool:
    """Write the entries of a batch once. A batch that is in the ledger writes nothing and isn't computed again; one that was ended
    while it wrote left nothing, since its folder appears as a whole. Entries of a batch have one day. Returns whether it was written."""
    if not read_ledger(spark, path).where((F.col("stream") == stream) & (F.col("batch") == batch)).isEmpty():
        return False
    rows = entries().withColumns({"day": F.to_date("ts"), "stream": F.lit(stream), "batch": F.lit(batch).cast("long")})
    # One file for a batch: as many entries as it had files.
    rows.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "stream", "batch").parquet(path)
    return True


class _Release(StreamingQueryListener):
    """Gives a lease back when its query ends."""

    def __init__(self, lease: Lease):
        self.lease, self.id = lease, None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.id) == self.id:
            self.lease.release()


def watch(spark: SparkSession, folder: str, extensions: list[str], ledger_path: str, checkpoint: str, process: Callable[[DataFrame], DataFrame], interval: str = "60 seconds", once: bool = False, stable_seconds: int = 120, lease_hours: float = HOURS) -> StreamingQuery:
    """Start the stream. The ledger is a Parquet folder by day, stream and batch; a batch that runs again adds no entry, and files
    that have a status aren't processed again.

    The stream holds a lease on the ledger: a second one, by another checkpoint, is refused with ``LeaseHeldError`` until the first
    has ended, or has not renewed its lease for ``lease_hours``; each batch renews it, and fails where another has taken over. The rate
    source only ticks: a file source would never show a file twice, and so lose those that weren't ready.
    """
    lease = Lease(spark, f"{ledger_path}/_leases", checkpoint, lease_hours).acquire()
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    read_ledger(spark, ledger_path)

    def tick(_, batch_id: int) -> None:
        lease.renew()
        now = F.lit(spark.sql("select current_timestamp() as t").first()["t"])
        record(spark, ledger_path, stream, batch_id, lambda: run(discover(spark, folder, extensions), read_ledger(spark, ledger_path), process, now, stable_seconds=stable_seconds))

    try:
        release = _Release(lease)
        spark.streams.addListener(release)
        ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        writer = ticks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(tick)
        query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
    except Exception:
        lease.release()
        raise
    release.id = query.id
    return query
