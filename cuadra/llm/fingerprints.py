"""MinHash document fingerprints: universal hash permutations over word shingles, banded and joined in Spark.

A fingerprint is ``K`` samples of 16 bits in hexadecimal. Equal texts have equal fingerprints; the share of equal samples, less
what chance adds, estimates the Jaccard similarity of the texts' shingle sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BIN, DBL, LONG, STR, MinHash, mix, partitions, range_buckets, schema, shingle_set, signed, spill
from .near_dedup import band_hashes

K = 256
SHINGLE = 5
#: A pair at a similarity of 0.8 shares no band with a probability of (1 - 0.8 ** 5) ** 40, about 1 in 10 million.
BANDS, ROWS = 40, 5
#: Classes of a band that meet a query in one task.
CROWD = 4096


def fingerprint(hashes: MinHash, s: np.ndarray) -> np.ndarray:
    """K samples of 16 bits of a set of shingles; that of a text without words is zeros."""
    # Minima are small numbers; mixing spreads them over 16 bits.
    return (mix(hashes.samples(s).astype(np.uint64)) & np.uint64(0xFFFF)).astype(">u2") if len(s) else np.zeros(hashes.k, ">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity, 0 to 1; chance makes one in 65,536 of the other samples equal."""
    same = float((a == b).mean())
    return max(0.0, (same - 2**-16) / (1 - 2**-16))


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of sets of shingles, which are sorted; sets without shingles are like nothing."""
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared / max(1, len(x) + len(y) - shared)


def verified(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> float | None:
    """Jaccard similarity of two sets whose fingerprints ``a`` and ``b`` share a band; None where they share none."""
    bands = min(BANDS, len(a) // ROWS)
    same = (a[: bands * ROWS] == b[: bands * ROWS]).reshape(bands, ROWS).all(1).any()
    return jaccard(x, y) if len(x) and len(y) and same else None


def _fingerprints(k: int, n: int):
    def task(it):
        hashes = MinHash(k)
        for pdf in it:
            yield pd.DataFrame({"doc_id": pdf.doc_id, "fingerprint": [fingerprint(hashes, shingle_set(t, n)).tobytes().hex() for t in pdf.text]})

    return task


def fingerprints(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint of every row. A null text counts as empty; an empty table gives an empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_fingerprints(k, shingle), schema(doc_id=LONG, fingerprint=STR))


def membership(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and representative, the least doc_id with an equal shingle set, of all rows with words and a doc_id.

    Joined with the pairs of ``similar_to`` on either side, it gives the pairs of all documents. A doc_id with several texts has a
    row for each of their classes."""

    def sign(it):
        for pdf in it:
            sets = [shingle_set(t, shingle) for t in pdf.text]
            rows = [(d, xxhash.xxh3_128_digest(s.tobytes())) for d, s in zip(pdf.doc_id, sets, strict=True) if len(s)]
            yield pd.DataFrame(rows, columns=["doc_id", "key"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(sign, schema(doc_id=LONG, key=BIN)).distinct()
    rows = spill(rows)
    # Representatives are joined, not collected, so that a large class can be split.
    return rows.join(rows.groupBy("key").agg(F.min("doc_id").alias("representative")), "key").select("doc_id", "representative")


def similar_to(queries: DataFrame, docs: DataFrame, similarity: float = 0.8, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE, crowd: int = CROWD) -> DataFrame:
    """Documents of ``docs`` like each document of a stated query set: query_id, doc_id, jaccard >= ``similarity``.

    Signature bands are joined in Spark on class representatives (equal shingle sets are one class), and Jaccard similarities are
    verified on full sets. Returns pairs of representatives, the least doc_id of their classes; ``membership`` of each
    side has the other documents of the classes.

    A band of over ``crowd`` classes is dealt out into parts, and its queries go to each. Both sides are signed once and written; only
    candidates fetch their texts again. Null ids and wordless texts are like nothing; an empty table on either side gives an empty one.
    """

    def sign(it):
        hashes = MinHash(bands * rows)
        for pdf in it:
            out = []
            for d, th, t in zip(pdf.doc_id, pdf.th, pdf.text, strict=True):
                s = shingle_set(t, shingle)
                if len(s):
                    out.append((d, th, xxhash.xxh3_128_digest(s.tobytes()), band_hashes(hashes.samples(s), bands, rows)))
            yield pd.DataFrame(out, columns=["doc_id", "th", "key", "bands"])

    def members(it):
        for pdf in it:
            yield pd.DataFrame({"key": pdf.key, "members": [shingle_set(t, shingle).tobytes() for t in pdf.text]})

    def verify(it):
        for pdf in it:
            found = [jaccard(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in zip(pdf.a, pdf.b, strict=True)]
            yield pd.DataFrame({"query_id": pdf.query_id, "doc_id": pdf.doc_id, "jaccard": found})

    def side(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        texts = df.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
        found = texts.mapInPandas(sign, schema(doc_id=LONG, th=LONG, key=BIN, bands=T.ArrayType(LONG)))
        return texts, spill(found.groupBy("key").agg(F.min(F.struct("doc_id", "th")).alias("first"), F.any_value("bands").alias("bands")))

    def sets(texts: DataFrame, classes: DataFrame, keys: DataFrame, name: str, value: str) -> DataFrame:
        wanted = spill(classes.join(keys.distinct(), "key", "left_semi").select("key", "first.doc_id", "first.th"))
        full = texts.join(wanted, ["doc_id", "th"]).select("key", "text").mapInPandas(members, schema(key=BIN, members=BIN))
        once = spill(full.groupBy("key").agg(F.any_value("members").alias(value)))  # rows that repeat id and text
        return once.join(classes.select("key", F.col("first.doc_id").alias(name)), "key")

    (texts_q, left), (texts_d, right) = side(queries), side(docs)
    q, d = left.select(F.col("key").alias("q"), F.explode("bands").alias("band")), right.select(F.col("key").alias("d"), F.explode("bands").alias("band"))
    # At most bands / crowd rows for each class.
    crowded = spill(d.groupBy("band").agg(F.ceil(F.count("*") / crowd).cast("int").alias("parts")).where("parts > 1"))
    parts = F.coalesce("parts", F.lit(1))
    d = d.join(crowded, "band", "left").select("band", "d", F.pmod(F.xxhash64("d"), parts).cast("int").alias("part"))
    q = q.join(crowded, "band", "left").select("band", "q", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    pairs = spill(q.join(d, ["band", "part"]).select("q", "d").distinct())
    a = sets(texts_q, left, pairs.select(F.col("q").alias("key")), "query_id", "a").withColumnRenamed("key", "q")
    b = sets(texts_d, right, pairs.select(F.col("d").alias("key")), "doc_id", "b").withColumnRenamed("key", "d")
    full = pairs.join(a, "q").join(b, "d").select("query_id", "doc_id", "a", "b")
    return full.mapInPandas(verify, schema(query_id=LONG, doc_id=LONG, jaccard=DBL)).where(F.col("jaccard") >= similarity)


def edited(text: str, after: str) -> str:
    """The last third of a text's code points replaced by the first as many, or all, of the next text."""
    third = len(text) // 3
    return text[: len(text) - third] + after[:third]


def _compare(k: int, n: int):
    def task(it):
        hashes = MinHash(k)

        def row(now, after):
            d, text, own, mine = now
            text2 = edited(text, after[1])
            set2 = shingle_set(text2, n)
            other = fingerprint(hashes, set2)
            near = likeness(own, other), likeness(own, after[2]), verified(mine, set2, own, other), verified(mine, after[3], own, after[2])
            return d, len(text), hashlib.sha256(text2.encode()).hexdigest(), own.tobytes().hex(), other.tobytes().hex(), *near

        names = _RESULT.names
        bucket, now = None, None
        for pdf in it:
            out = []
            for b, known, d, t, guest in zip(pdf.bucket, pdf.known, pdf.doc_id, pdf.text, pdf.guest, strict=True):
                if guest and (b != bucket or now is None):  # only the first one follows
                    continue
                words = shingle_set(t, n)
                this = (int(d) if known else None, t or "", fingerprint(hashes, words), words)
                if now is not None and b == bucket:
                    out.append(row(now, this))
                bucket, now = b, None if guest else this
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64", "jaccard_edited": float, "jaccard_next": float})

    return task


def compare_with_edits(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Fingerprint every text, its edited text and the next one, in descending doc_id order (the first follows the last).

    Takes ``doc_id`` and ``text``; other columns are ignored, whatever their names. A null text counts as empty; null doc_ids
    come last; rows that repeat a doc_id are ordered by text, descending; a single row follows itself. An empty table gives an
    empty one.

    ``near_edited`` and ``near_next`` are estimates; ``jaccard_edited`` and ``jaccard_next`` are the similarities themselves, verified on full sets,
    of the pairs whose fingerprints share a band, and null for the others.

    One shuffle deals texts out by ranges of doc_id. The first row of each range also goes to the end of the range before it; only
    these ids, one for each range, reach the driver.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranged, n = range_buckets(docs, "doc_id")
    # Null ids are those that aren't known; their number means nothing.
    ranged = ranged.select((n - 1 - F.col("bucket")).alias("bucket"), F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "text")
    first = ranged.groupBy("bucket").agg(F.max(F.struct("known", "doc_id")).alias("m")).select("bucket", "m.*").sort("bucket").collect()
    if not first:
        return docs.mapInPandas(_none, _RESULT)
    # The first rows of buckets, a row of three values for each bucket, also go to the bucket before.
    to = docs.sparkSession.createDataFrame([(r["known"], int(r["doc_id"]), int(first[k - 1]["bucket"])) for k, r in enumerate(first)], "known boolean, doc_id long, goes_to int")
    own = F.struct(F.col("bucket").cast("int").alias("bucket"), F.lit(0).alias("guest"))
    both = F.when(F.col("goes_to").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("goes_to").alias("bucket"), F.lit(1).alias("guest"))))
    every = ranged.join(F.broadcast(to), ["known", "doc_id"], "left").select("known", "doc_id", "text", F.explode(both).alias("at")).select("at.*", "known", "doc_id", "text")
    ordered = every.repartition(partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket", "guest", F.desc("known"), F.desc("doc_id"), F.desc("text"))
    return ordered.select("bucket", "known", "doc_id", "text", "guest").mapInPandas(_compare(k, shingle), _RESULT)


_RESULT = schema(doc_id=LONG, n_chars=LONG, edited_sha256=STR, fingerprint=STR, edited_fingerprint=STR, near_edited=DBL, near_next=DBL, jaccard_edited=DBL, jaccard_next=DBL)


def _none(it):
    yield from ()


def op10(spark, sf_dir: str) -> DataFrame:
    return compare_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
