"""Queries of the streams: whole tables that come in several batches, each with the SQL of the table at rest."""

from __future__ import annotations

from pyspark.sql import functions as F

from .queries import query, read
from .sources.scratch import shared_folder
from .streaming import agent

BATCHES = 4
#: Lines of a file of a batch.
FILE_LINES = 500_000
_LINES_SQL = "SELECT CAST(l_suppkey AS VARCHAR) AS doc, (l_orderkey * 8 + l_linenumber) * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS pos, l_returnflag AS label, l_extendedprice AS amount, l_returnflag = 'R' AS terminal FROM lineitem WHERE l_extendedprice > 0"


@query(f"""
WITH l AS ({_LINES_SQL}),
o AS (SELECT *, coalesce(sum(CAST(terminal AS INT)) OVER (PARTITION BY doc ORDER BY pos, label, amount ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block, sum(CAST(terminal AS INT)) OVER (PARTITION BY doc) AS ends FROM l)
SELECT doc, CAST(block AS BIGINT) AS block, label, arg_max(amount, pos) AS amount FROM o WHERE block < ends GROUP BY 1, 2, 3""")
def streamed_blocks(spark, sf_dir):
    """Lines of lineitem by supplier, which come in four batches and up to a fiftieth of the table out of order."""
    lines = read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("doc"), ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100_000_000 + F.round(F.col("l_extendedprice") * 100).cast("long")).alias("pos"), F.col("l_returnflag").alias("label"), F.col("l_extendedprice").alias("amount"), (F.col("l_returnflag") == "R").alias("terminal")
    )
    lines = lines.join(lines.groupBy("doc").agg(F.count("*").alias("lines")), "doc")
    last, n = lines.agg(F.max("pos"), F.count("*")).first()
    last, files = last or 1, n // (BATCHES * FILE_LINES) + 1
    place = F.col("pos") / last + F.pmod(F.xxhash64("pos"), F.lit(1000)) / 50_000
    arrival = F.least(F.floor(place * BATCHES), F.lit(BATCHES - 1))
    at = shared_folder(spark, "stream")
    for k in range(BATCHES):
        lines.where(arrival == k).repartition(files).write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", files).parquet(f"{at}/in")
    blocks = agent.closed_blocks(stream, slack=200)
    run = blocks.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(blocks.schema).parquet(f"{at}/out")


@query("""
SELECT CAST(event_id AS VARCHAR) AS name, event_type AS status, count(*) AS n FROM events GROUP BY ALL""")
def status_written_once(spark, sf_dir):
    """Entries of all events in four batches, each of which is run again after it was written."""
    events = read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("name"), F.col("event_type").alias("status"), "ts", F.lit("").alias("message"), "event_id")
    now = F.lit("2024-01-08 00:00:00").cast("timestamp")
    ledger = shared_folder(spark, "ledger")
    for k in range(BATCHES):
        for _ in range(2):
            agent.record(spark, ledger, "stream", k, lambda k=k: events.where(F.pmod("event_id", F.lit(BATCHES)) == k).drop("event_id").withColumn("ts", now))
    return agent.read_ledger(spark, ledger).groupBy("name", "status").agg(F.count("*").alias("n"))
