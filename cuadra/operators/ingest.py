"""Incremental ingestion: discovery, stability, the status ledger, grouping and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import age_seconds
from ..functions.text import norm_path, with_name_tokens
from ..sources.scratch import removed, written

#: Fixed: extensions by folder kind.
EXTENSIONS = {"tarjetas": ["pdf", "png", "jpg", "jpeg"], "compras": ["pdf", "png", "jpg", "jpeg"], "bancos": ["xls", "xlsx"]}


def discover(spark: SparkSession, folder: str, extensions: list[str]) -> DataFrame:
    """Files directly in a folder, by lower-case name: path, name, ext, length, modificationTime. Contents aren't read."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length", "modificationTime")
    files = files.withColumn("name", F.substring_index("path", "/", -1)).withColumn("ext", F.lower(F.substring_index("name", ".", -1)))
    return files.where(F.col("ext").isin([e.lower().lstrip(".") for e in extensions])).orderBy(F.lower("name"))


def split_paths(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Paths of semicolon- or line-separated lists, without quotes and repeats; the first is kept, in order of columns."""
    parts = F.flatten(F.array(*[F.split(F.coalesce(F.col(c), F.lit("")), r"[;\r\n]+") for c in columns]))
    long = rows.select(*by, F.posexplode(parts).alias("pos", "raw")).withColumn("path", F.regexp_replace(F.trim("raw"), "^[\"']+|[\"']+$", "")).where("path <> ''")
    return long.groupBy(*by, norm_path(F.col("path")).alias("path_key")).agg(F.min_by("path", "pos").alias("path"), F.min("pos").alias("pos"))


def base_path(path: Column) -> Column:
    """The parent where the last part names a kind of documents."""
    return F.regexp_replace(path, r"(?i)[\\/]+(tarjetas|compras)[\\/]*$", "")


def stable(length: Column, modified: Column, now: Column, seconds: int = 120) -> Column:
    return (length > 0) & (age_seconds(modified, now) >= seconds)


def pending(files: DataFrame, ledger: DataFrame, key: str = "name", force: bool = False) -> DataFrame:
    """Files without a status, and those whose last one is ERROR. A status that is missing in its entry counts as done."""
    if force:
        return files
    last = ledger.groupBy(key).agg(F.max_by(F.coalesce(F.upper("status"), F.lit("")), "ts").alias("status"))
    return files.join(last.where("status <> 'ERROR'"), key, "left_anti")


def group_documents(files: DataFrame, name: str = "name", modified: str = "modificationTime") -> DataFrame:
    """Files of one document together, by provider, date and voucher in their names; names without all three stand alone.

    A document has few files; its members are ordered by time, then name; ``n`` counts them.
    """
    known = with_name_tokens(files.select(F.col(name).alias("name"), F.col(modified).alias("modified")), F.trim(F.regexp_replace(F.regexp_replace(F.col("name"), r"\.[^.]*$", ""), r"\s+", " ")))
    parts = ["_provider", "_date", "_voucher"]
    key = F.when(F.col(parts[0]).isNotNull() & F.col(parts[1]).isNotNull() & F.col(parts[2]).isNotNull(), F.concat_ws("|", *parts))
    member = F.struct("modified", F.lower("name").alias("lname"), "name")
    return known.groupBy(F.coalesce(key, F.concat(F.lit("file:"), F.col("name"))).alias("document")).agg(F.array_sort(F.collect_list(member)).alias("members"), F.count("*").alias("n"))


def with_route(rows: DataFrame, routes: DataFrame, key: str, value: str, default) -> DataFrame:
    """Look up a route; ``default`` and ``missing`` where there is none."""
    found = rows.join(routes, key, "left")
    return found.withColumn("missing", F.col(value).isNull()).withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def last_route(rows: DataFrame, id_column: str, route: str, order: str) -> DataFrame:
    """Clients with an integer id and a route that isn't blank; the last wins."""
    kept = rows.withColumn("id", F.col(id_column).try_cast("int")).where(F.col("id").isNotNull() & (F.trim(route) != ""))
    return kept.groupBy("id").agg(F.max_by(route, order).alias("route"))


def tables_with(columns: DataFrame, wanted: list[str], preferred: str) -> DataFrame:
    """Tables of a catalog (table_schema, table_name, column_name) that have all wanted columns; the preferred name first."""
    have = columns.where(F.col("column_name").isin(wanted)).groupBy("table_schema", "table_name").agg(F.countDistinct("column_name").alias("n")).where(F.col("n") == len(wanted))
    return have.orderBy(F.when(F.lower("table_name") == preferred.lower(), 0).otherwise(1), "table_schema", "table_name").drop("n")


def retained(ledger: DataFrame, now: Column, days: int = 7, ts: str = "ts") -> DataFrame:
    """Entries of the last days. Files whose entry goes are processed again if they are still there. Of a ledger in folders by
    ``day``, only the folders of those days are read."""
    since = now - F.expr(f"interval {days} days")
    kept = ledger.where(F.col(ts) >= since)
    return kept.where(F.col("day") >= F.to_date(since)) if "day" in ledger.columns else kept


def compacted(spark: SparkSession, path: str, before: str, key: str = "name", ts: str = "ts") -> int:
    """Rewrite the days of a ledger (a folder of Parquet by ``day``, then perhaps finer) before the date ``before``: of each key only
    its last entry stays, in the folder of its day. Returns how many entries went.

    Days are read and written once. Each old day is replaced as a whole, by renames, after all that is to stay has been written. A
    run that ends halfway loses nothing: the next puts back a day that was being replaced, and what else is left over are entries
    that aren't the last. No stream may write to the old days meanwhile; those that hold the ledger's lease write to the day that it is.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    aside, fresh = f"{path}/_replaced", f"{path}/_compacted"
    for day in [s.getPath().getName() for s in fs.listStatus(hadoop.Path(aside))] if fs.exists(hadoop.Path(aside)) else []:
        if not fs.exists(hadoop.Path(f"{path}/{day}")):
            fs.rename(hadoop.Path(f"{aside}/{day}"), hadoop.Path(f"{path}/{day}"))
    fs.delete(hadoop.Path(aside), True)
    fs.delete(hadoop.Path(fresh), True)
    ledger = spark.read.parquet(path)
    finer = [c for c in ledger.columns if c not in ("day",) and c in _folders(spark, path)]
    old = ledger.where(F.col("day") < F.lit(before).cast("date"))
    order = F.struct(ts, *sorted(c for c in ledger.columns if c not in (ts, key)))
    last = old.groupBy(key).agg(F.max_by(F.struct(*ledger.columns), order).alias("e")).select("e.*")
    kept, at = written(last, "ledger")
    n, left = old.count(), kept.count()
    if n > left:
        days = [r["day"] for r in old.select("day").distinct().collect()]  # one row for each day
        kept.repartition("day").write.partitionBy("day", *finer).parquet(fresh)
        fs.mkdirs(hadoop.Path(aside))
        for day in sorted(days):
            place, new, old_day = (hadoop.Path(f"{p}/day={day}") for p in (path, fresh, aside))
            fs.rename(place, old_day)
            if fs.exists(new):
                fs.rename(new, place)
            fs.delete(old_day, True)
        fs.delete(hadoop.Path(fresh), True)
        fs.delete(hadoop.Path(aside), True)
    removed(spark, at)
    return n - left


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the columns that a table's folders stand for."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs, at, found = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), hadoop.Path(path), []
    while at is not None:
        below = [s.getPath() for s in fs.listStatus(at) if s.isDirectory() and "=" in s.getPath().getName()]
        at = below[0] if below else None
        found += [at.getName().split("=")[0]] if below else []
    return found


def status_of_log(text: Column) -> Column:
    """What a status log's first STATUS line says, upper case; null without one."""
    return F.nullif(F.upper(F.trim(F.regexp_extract(text, r"(?m)^STATUS=(.*)$", 1))), F.lit(""))


def env_entries(lines: DataFrame, line: str = "value") -> DataFrame:
    """KEY=VALUE lines; blank ones, comments and lines without ``=`` go, quotes too."""
    t = F.trim(line)
    kept = lines.where((t != "") & ~t.startswith("#") & F.contains(t, F.lit("=")))
    parts = F.split(F.trim(line), "=", 2)
    return kept.select(F.trim(parts[0]).alias("key"), F.regexp_replace(F.trim(parts[1]), "^[\"']|[\"']$", "").alias("value"))


def page_chunks(pages: DataFrame, by: str, page: str, n: int) -> DataFrame:
    """Ranges of ``n`` pages, with the name of the part; one range where n is 0 or the document isn't longer."""
    total = pages.groupBy(by).agg(F.max(page).alias("total"))
    size = F.when((F.lit(n) <= 0) | (F.col("total") <= n), F.col("total")).otherwise(F.lit(n))
    starts = total.select(by, "total", size.alias("size"), F.explode(F.sequence(F.lit(1), F.col("total"), size.cast("int"))).alias("first"))
    last = F.least(F.col("first") + F.col("size") - 1, F.col("total"))
    return starts.select(by, "first", last.alias("last"), F.when(F.col("size") < F.col("total"), F.format_string("%s_p%03d-%03d.pdf", F.regexp_replace(by, r"\.[^.]*$", ""), "first", last)).otherwise(F.col(by)).alias("part"))


def image_tiles(images: DataFrame, height: str, n: int) -> DataFrame:
    """``top`` and ``bottom`` of n horizontal bands (1 to 6) that overlap by a tenth of their height, 20 to 60 pixels."""
    n = min(6, max(1, n))
    h = F.col(height)
    band = F.ceil(h / n).cast("int")
    overlap = F.least(F.lit(60), F.greatest(F.lit(20), F.floor(band / 10))).cast("int")
    k = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")
    rows = images.select("*", k)
    pad = overlap if n > 1 else F.lit(0)
    return rows.withColumn("top", F.greatest(F.lit(0), F.col("k") * band - pad)).withColumn("bottom", F.least(h, (F.col("k") + 1) * band + pad)).where("top < bottom")


#: Fixed: how many files a run of a kind takes.
MOST_FILES = {"compras": 5, "tarjetas": 100, "bancos": 1}


def checked_count(files: DataFrame, most: int) -> DataFrame:
    """``files``, or an error where there are none or more than ``most``; one more than these are counted."""
    n = files.limit(most + 1).count()
    if not 1 <= n <= most:
        raise ValueError(f"from 1 to {most} files are needed, not {'none' if not n else 'more'}")
    return files
