"""Best-fit packing by minimum bin slack.

Packing depends on lengths alone, of which there are at most as many as a sequence has tokens. The driver gets the histogram of
lengths, never rows: for each bin, a bitset subset-sum dynamic programme over the lengths left finds the fullest combination,
which is removed as often as the histogram allows. Pieces then find their places by their rank within their length. Bins that
keep room are emptied, with some others, and packed again by the same programme.
"""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import INT, LONG, schema, spill
from .tokens import END, encoder, vocabulary_path

CAPACITY = 1024
#: How often bins are packed again, and the share of full ones among them.
REPACKS, REPACKED = 6, 0.3
#: Ranks within a length are counted in parts: 65,536 in all, and one more for each length, or fewer, of 1,000 pieces at least.
PARTS, PART_ROWS = 1 << 16, 1000


def fullest(left: dict[int, int], capacity: int, order) -> list[int]:
    """The fullest combination of lengths within ``capacity`` that has the largest length left: one bin of minimum slack."""
    largest = max(left)
    sums = 1 << largest
    steps: list[tuple[int, int]] = []  # a length and the sums before it
    target = largest
    for length in order(left):
        copies = min(left[length] - (length == largest), (capacity - largest) // length)
        for _ in range(copies):
            steps.append((length, sums))
            new = (sums | sums << length) & ((2 << capacity) - 1)
            if new == sums:
                steps.pop()
                break
            sums = new
        if sums >> capacity & 1:
            break
    target = sums.bit_length() - 1
    chosen = [largest]
    for length, before in reversed(steps):
        if not before >> target & 1:
            chosen.append(length)
            target -= length
    return chosen


Bins = list[tuple[list[int], int]]
#: In which order the programme adds lengths: of equally full combinations it prefers those of lengths that come early.
ORDERS = [
    lambda left: sorted(left, reverse=True),
    lambda left: sorted(left),
    lambda left: sorted(left, key=lambda n: (-left[n] * n, n)),
]


def minimum_slack(histogram: dict[int, int], capacity: int, order=ORDERS[0]) -> Bins:
    """(lengths of a bin, number of such bins), each bin the fullest one at its time."""
    left = {n: c for n, c in histogram.items() if c > 0}
    out = []
    while left:
        bin_ = fullest(left, capacity, order)
        uses = Counter(bin_)
        times = min(left[n] // k for n, k in uses.items())
        for n, k in uses.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        out.append((bin_, times))
    return out


def number(bins: Bins) -> int:
    return sum(times for _, times in bins)


def patterns(histogram: dict[int, int], capacity: int) -> Bins:
    """Minimum slack in each order, the fewest bins. Then bins with room, and a share of the full ones, are emptied and packed again,
    by the same programme, as long as there are more bins than tokens ask for."""
    bins = min((minimum_slack(histogram, capacity, order) for order in ORDERS), key=number)
    fewest = -(-sum(n * c for n, c in histogram.items()) // capacity)
    chance = random.Random(1)
    for k in range(REPACKS):
        if number(bins) <= fewest:
            break
        kept, emptied = [], Counter()
        for lengths, times in bins:
            again = times if capacity - sum(lengths) > capacity // 256 else int(times * REPACKED + chance.random())
            for n in lengths:
                emptied[n] += again
            if times > again:
                kept.append((lengths, times - again))
        new = kept + minimum_slack(emptied, capacity, ORDERS[k % len(ORDERS)])
        if number(new) <= number(bins):
            bins = new
    return bins


def _pieces(path: str, capacity: int):
    def task(it):
        for pdf in it:
            rows = []
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                for d, ids in zip(part.doc_id, encoder(path).encode(part.text.tolist()), strict=True):
                    ids = np.append(ids, np.uint32(END)).astype("<u4")
                    # The remainder goes first, so that all other pieces are full.
                    cuts = np.r_[0, np.arange(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                        rows.append((d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return task


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Pack all token pieces into sequences of at most ``capacity`` tokens.

    Takes ``doc_id`` and ``text`` of ``docs``; other columns are ignored, whatever their names. Returns per piece: doc_id, piece,
    start, length, ids_crc32, sequence_id, offset. A null or empty text is the end id alone; a document longer than a sequence
    is cut, its first piece taking the remainder; repeated rows are packed as often as they occur and a null doc_id stays null.
    An empty table gives an empty one.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Tokenized once: the histogram and the places both read the narrow rows.
    pieces = spill(docs.mapInPandas(_pieces(path or vocabulary_path(), capacity), schema(doc_id=LONG, piece=INT, start=LONG, length=LONG, ids_crc32=LONG)))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row for each length
    # Full pieces are sequences of their own; the others share.
    whole, shared = pieces.where(F.col("length") == capacity), pieces.where(F.col("length") < capacity)
    histogram.pop(capacity, None)
    rows_each = max(PART_ROWS, -(-sum(histogram.values()) // PARTS))
    parts = spark.createDataFrame([(n, -(-c // rows_each)) for n, c in histogram.items()], schema(length=LONG, parts=LONG))
    # Both broadcasts below are bounded: a row for each length, and for each part.
    shared = shared.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "parts").cast("int")).drop("parts")
    counts = spill(shared.groupBy("length", "part").agg(F.count("*").alias("n")))
    starts = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))

    # One row for each length of each pattern: ranks from, of which each of its bins takes ``k``, bins from, place of the first.
    rows, used, bins = [], Counter(), 0
    for lengths, times in patterns(histogram, capacity):
        offset = 0
        for n in dict.fromkeys(lengths):
            k = lengths.count(n)
            rows.append((n, used[n], used[n] + k * times, k, bins, offset))
            used[n] += k * times
            offset += k * n
        bins += times
    places = spark.createDataFrame(rows, schema(length=LONG, first=LONG, last=LONG, k=LONG, bin=LONG, at=LONG))
    # At most one row of ranges for each length: arrays of bounded size, from the bounded histogram.
    places = places.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "last", "k", "bin", "at"))).alias("ranges"))

    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = shared.withColumn("rank", rank).join(F.broadcast(starts), ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.join(F.broadcast(places), "length").withColumn("r", F.filter("ranges", lambda r: (r["first"] <= F.col("rank")) & (F.col("rank") < r["last"]))[0])
    nth = F.col("rank") - F.col("r.first")
    alone = whole.select("doc_id", "piece", "start", "length", "ids_crc32", (F.monotonically_increasing_id() + bins).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    placed = placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("r.bin") + F.floor(nth / F.col("r.k"))).cast("long").alias("sequence_id"), (F.col("r.at") + nth % F.col("r.k") * F.col("length")).cast("long").alias("offset"))
    return placed.union(alone)


def op3(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))

