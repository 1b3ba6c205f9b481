"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

#: Odd multipliers of 64-bit mixing.
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)
ROLL = 0x9E3779B97F4A7C15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; a temporary one only where that is unset and there
    are no executors elsewhere (tests)."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if at is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(at)
    return at


def spill(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spill-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer, so that sums of hashes become uniform again."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def token_codes(texts) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Tokens between ASCII white space of many texts: a number for each, where the tokens of each text begin and the last ones
    end, and the distinct tokens by number. Null texts have none."""
    parts = pc.ascii_split_whitespace(pa.array(texts, pa.large_string(), from_pandas=True).fill_null(""))
    found = parts.flatten().dictionary_encode()
    codes, tokens = found.indices.to_numpy(), found.dictionary.to_pylist()
    bounds = parts.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0] if len(bounds) else 0
    if "" in tokens:  # white space at either end of a text
        real = codes != tokens.index("")
        bounds = np.r_[0, np.cumsum(real)][bounds]
        codes = codes[real]
    return codes, bounds, tokens


def by_length(it: Iterator, most: int = 1 << 23) -> Iterator:
    """Cut the pandas batches of a task into pieces of about ``most`` characters of ``text``; a longer text is a piece of its own."""
    for pdf in it:
        part = (np.cumsum([len(t) if isinstance(t, str) else 0 for t in pdf.text]) - 1) // most
        for at in np.split(np.arange(len(pdf)), np.flatnonzero(np.diff(part)) + 1):
            if len(at):
                yield pdf.iloc[at[0] : at[-1] + 1]


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every ``n`` consecutive words; empty if there are fewer."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for j in range(n):
        out += hashes[j : j + len(out)] * np.uint64(pow(ROLL, j + 1, 1 << 64))
    return mix(out)


def shingle_set(text: str | None, n: int = 5, lower: bool = True) -> np.ndarray:
    """Sorted distinct hashes of a text's ``n``-word shingles; the whole sequence as one where it is shorter; empty without words."""
    if not text:
        return np.empty(0, np.uint64)
    raw = text.encode()
    words = (raw.lower() if lower else raw).split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(word_hashes(words), min(n, len(words))))


class MinHash:
    """``k`` universal multiply-add hash permutations over 64-bit shingles; the samples are the top 32 bits of each minimum."""

    def __init__(self, k: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.k = k
        self.a = rng.integers(0, 2**63, k, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, k, np.uint64)[:, None]

    def samples(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(self.k, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(shingles), 1024):
            np.minimum(least, (shingles[None, at : at + 1024] * self.a + self.b).min(1), out=least)
        return (least >> np.uint64(32)).astype(np.uint32)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def range_buckets(df: DataFrame, key: str, rows_per_bucket: int = 500) -> tuple[DataFrame, int]:
    """Add ``bucket``: contiguous ranges of the integer ``key``, in ascending order, of about equal numbers of rows.

    Only cut points reach the driver: approximate quantiles of the narrow key column, one for each bucket, of which there are 16 for
    each shuffle partition at most. Null keys are in bucket 0. Returns the frame and the number of buckets.
    """
    n = max(1, min(16 * partitions(df.sparkSession), -(-df.count() // rows_per_bucket)))
    cuts: list[int] = []
    if n > 1:
        cuts = sorted({float(c) for c in df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10 * n)).first()[0] or []})
    if not cuts:
        return df.withColumn("bucket", F.lit(0)), 1
    # A search among the cut points. Large keys are rounded to doubles, which keeps their order.
    rounded = df.withColumn("_key", F.coalesce(F.col(key).cast("double"), F.lit(float("-inf"))))
    found = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_key", outputCol="_bucket").transform(rounded)
    return found.withColumn("bucket", F.col("_bucket").cast("int")).drop("_key", "_bucket"), len(cuts) + 1


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: rows (id, label), label the least id of the component.

    Alternates the large-star and small-star steps on DataFrames; only counts reach the driver. Hubs are safe: minima are
    combined before the shuffle and the joins can be split. Ids without a link to another id aren't returned.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = checkpoint(e)
    before = None
    for _ in range(60):
        # Large star: each node passes its least neighbour to its larger neighbours.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Minima are written first: a join of two sides that are dealt out for it can split the edges of a hub.
        low = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        e = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: each node links its smaller neighbours, and itself, to the least of them.
        e = checkpoint(e)
        low = checkpoint(e.groupBy("u").agg(F.min("v").alias("m")))
        e = e.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        e = checkpoint(e)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before or not now["n"]:
            break
        before = now
    else:  # rounds grow with the logarithm of the longest path
        raise RuntimeError("components are unfinished after 60 rounds")
    labels = e.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("id"), "label")
    return labels.union(labels.select(F.col("label").alias("id"), "label").distinct())


def batches_by(it: Iterator, size: int) -> Iterator:
    """Cut the pandas batches of a task into pieces of at most ``size`` rows."""
    for pdf in it:
        for at in range(0, len(pdf), size):
            yield pdf.iloc[at : at + size]


def sorted_groups(it: Iterator, keys: list[str]) -> Iterator:
    """Groups of the sorted rows of a task, one at a time; a group that goes on in the next batch is put together."""
    held = None
    for pdf in it:
        if held is not None:
            pdf = pd.concat([held, pdf], ignore_index=True)
        if len(pdf):
            cut = np.flatnonzero((pdf[keys].to_numpy()[1:] != pdf[keys].to_numpy()[:-1]).any(1)) + 1
            begin = [0, *cut.tolist()]
            for a, b in zip(begin[:-1], begin[1:], strict=True):
                yield pdf.iloc[a:b]
            held = pdf.iloc[begin[-1] :]
    if held is not None and len(held):
        yield held


LONG, INT, STR, BIN, DBL, BOOL = T.LongType(), T.IntegerType(), T.StringType(), T.BinaryType(), T.DoubleType(), T.BooleanType()


def schema(**kinds) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])
