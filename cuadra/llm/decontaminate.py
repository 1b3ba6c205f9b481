"""Benchmark decontamination with SQL functions only.

Hashes of the benchmark's n-grams are broadcast, behind a check of their number; training token windows are scanned against
them, hits are verified on the words themselves, and spans or documents can be removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spill

WINDOW = 10
#: Windows with their words and item ids beyond so many bytes are joined by a shuffle instead of broadcast.
BROADCAST_BYTES = 64 << 20

DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a text before A-Z are lowered; there they are no delimiters.
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, nothing else; the fast function does where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), DELIMITERS), lambda w: w != "")


def _windows(w: Column, n: int) -> Column:
    """Array of (n, place from 0, hash) of every ``n`` consecutive words."""
    every = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(every, lambda i: F.struct(F.lit(n).alias("n"), i.alias("place"), F.xxhash64(F.slice(w, i + 1, n)).alias("h")))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per hash of a window: h, found (array of its words and the ids of items that have them), n."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    grams = items.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, n))).alias("gram"))
    grams = grams.groupBy("gram").agg(F.collect_set("item_id").alias("items")).withColumn("h", F.xxhash64("gram")).withColumn("n", F.size("gram"))
    return grams.groupBy("h").agg(F.collect_list(F.struct("n", F.array_join("gram", " ").alias("gram"), "items")).alias("found"))


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, text, n_words, hits (array of place, n and items of each verified occurrence, by place).

    Takes ``doc_id`` and ``text``, and ``item_id`` and ``text`` of ``benchmark``; other columns are ignored, whatever their
    names. An item of fewer words than a window is one window; items without words, or with a null id, find nothing. A null,
    empty or wordless text has no words and no hits. Rows that repeat a doc_id are judged each by its own text. An empty
    benchmark finds nothing; an empty table gives an empty one.
    """
    none = F.lit(-(1 << 63))
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), none).alias("doc_id"), "text").withColumn("th", F.xxhash64("text"))
    wanted = spill(benchmark_windows(benchmark.where("item_id is not null"), window))  # found once, read by both uses
    # Per length of windows, of which there are ``window`` at most: the bytes of their words and ids, and 64 for each.
    of_items = F.size("f.items") * 16 + F.length(F.array_join(F.transform("f.items", lambda i: i.cast("string")), ""))
    sizes = wanted.select(F.explode("found").alias("f")).groupBy("f.n").agg(F.sum(F.octet_length("f.gram") + of_items + 64).alias("bytes")).collect()
    lengths = sorted(r["n"] for r in sizes)
    if sum(r["bytes"] for r in sizes) <= broadcast_bytes:
        wanted = F.broadcast(wanted)
    split = docs.select("doc_id", "th", words(F.col("text")).alias("w"))
    windows = F.concat(*[_windows(F.col("w"), n) for n in lengths or [window]])
    scanned = split.select("doc_id", "th", F.explode(windows).alias("x")).select("doc_id", "th", "x.n", "x.place", "x.h")
    likely = scanned.join(wanted, "h").groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("place", "n", "found"))).alias("likely"))
    both = docs.join(likely, ["doc_id", "th"], "left").select("doc_id", "text", words(F.col("text")).alias("w"), "likely")
    # The words themselves decide, not their hashes.
    same = lambda x: F.filter(x["found"], lambda f: (f["n"] == x["n"]) & (f["gram"] == F.array_join(F.slice("w", x["place"] + 1, x["n"]), " ")))
    checked = F.transform("likely", lambda x: F.struct(x["place"].alias("place"), x["n"].alias("n"), F.flatten(F.transform(same(x), lambda f: f["items"])).alias("items")))
    hits = F.filter(F.coalesce(checked, F.array().cast(f"array<struct<place:int,n:int,items:array<{dict(benchmark.dtypes)['item_id']}>>>")), lambda x: F.size(x["items"]) > 0)
    return both.select(F.nullif("doc_id", none).alias("doc_id"), "text", F.size("w").cast("long").alias("n_words"), hits.alias("hits"))


def covered(hits: Column) -> Column:
    """How many words the occurrences cover, overlaps once."""
    step = lambda a, x: F.struct(F.greatest(a["end"], x["place"] + x["n"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["place"] + x["n"] - F.greatest(a["end"], x["place"]))).alias("n"))
    return F.aggregate(hits, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step, lambda a: a["n"].cast("long"))


def report(found: DataFrame) -> DataFrame:
    items = F.array_sort(F.array_distinct(F.transform(F.flatten(F.transform("hits", lambda x: x["items"])), lambda i: i.cast("string"))))
    rows = found.select("doc_id", "n_words", covered(F.col("hits")).alias("n_hit"), items.alias("items"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs``, all columns, without the documents that hold a benchmark window. Rows of one doc_id and text go together."""
    bad = find_hits(docs, benchmark, window).where(F.size("hits") > 0).select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_id"), F.xxhash64("text").alias("_th")).distinct()
    same = (F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63))) == bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_th"])
    return docs.join(bad, same, "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs``, all rows and columns, without the words that lie in benchmark windows. What stands before and after a removed span
    stays; ``n_chars`` follows where there is one. Texts without hits, null ones included, stay as they are."""
    none = F.lit(-(1 << 63))
    bad = find_hits(docs, benchmark, window).where(F.size("hits") > 0)
    hit = F.flatten(F.transform("hits", lambda x: F.sequence(x["place"], x["place"] + x["n"] - 1)))
    bad = bad.select(F.coalesce("doc_id", none).alias("id"), F.xxhash64("text").alias("th"), hit.alias("hit")).dropDuplicates(["id", "th"])
    # Columns of ``docs`` stay together, so that no name of theirs can clash.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), none).alias("id"), F.xxhash64("text").alias("th")).join(bad, ["id", "th"], "left")
    text = F.when(F.col("hit").isNotNull(), F.col("row.text"))
    rows = rows.select("row", "hit", F.split(text, WORDS, -1).alias("between"), F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)).alias("words"))
    # A word goes together with the delimiters after it.
    kept = F.array_except(F.sequence(F.lit(0), F.size("words") - 1), F.col("hit"))
    clean = F.concat(F.get("between", F.lit(0)), F.array_join(F.transform(kept, lambda i: F.concat(F.get("words", i), F.get("between", i + 1))), ""))
    rows = rows.select("row", F.when(F.col("hit").isNotNull(), clean).alias("clean"))
    new = {"text": F.coalesce("clean", "row.text"), "n_chars": F.coalesce(F.length("clean"), F.col("row")["n_chars"]).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return rows.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def op7(spark, sf_dir: str) -> DataFrame:
    return report(find_hits(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, n, gram FROM (
    SELECT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS gram FROM b WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS gram FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lengths WHERE len(w) >= n)
), hits AS (SELECT r, p, n, item_id FROM dw JOIN bw USING (n, gram)
), hit_words AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY r
), hit_items AS (SELECT r, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items_sha256 FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""
