"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score is the logistic of ``w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``: all pairwise interactions
of low rank in linear time. It is fitted on the driver, on a bounded sample of labelled rows, and scored in Spark tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import DBL, LONG, by_length, gram_hashes, schema, spill, token_codes, word_hashes

#: Buckets of hashed words, rank of the interactions, labelled rows that are learnt from at most, and passes over them.
BUCKETS, RANK, SAMPLE, EPOCHS = 1 << 15, 8, 6000, 6
#: Numbers (index and value, 8 bytes) that all labelled rows which are learnt from have at most; one row has 32,784 at most.
PAIRS = 16_000_000
THRESHOLD = 0.7
STATISTICS = 16


def statistics(raw: bytes, hashes: np.ndarray, n_chars: float) -> np.ndarray:
    """Shape of a text: characters, repetition, lines and length. All are 0 for an empty one, but for the length."""
    out = np.zeros(STATISTICS, np.float32)
    out[15] = np.log1p(max(0.0, n_chars)) / 10  # metadata
    if not len(hashes):
        return out
    kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = len(raw)
    letters = kinds[65:91].sum() + kinds[97:123].sum()
    solid = size - kinds[32] - kinds[10]
    marks = kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum()
    counts = np.unique(hashes, return_counts=True)[1]
    grams = gram_hashes(hashes, min(4, len(hashes)))
    lines = raw.split(b"\n")
    out[0] = kinds[65:91].sum() / max(1, letters)
    out[1] = marks / max(1, solid)
    out[2] = kinds[48:58].sum() / max(1, solid)
    out[3] = (kinds[33] + kinds[35:39].sum() + kinds[42]) / max(1, solid)  # ! # $ % & *
    out[4] = kinds[128:].sum() / size
    out[5] = solid / len(hashes) / 10
    out[6] = len(counts) / len(hashes)
    out[7] = counts.max() / len(hashes)
    out[8] = (hashes[1:] == hashes[:-1]).mean() if len(hashes) > 1 else 0
    out[9] = len(np.unique(grams)) / len(grams)
    out[10] = 1 - len(set(lines)) / len(lines)
    out[11] = len(lines) / len(hashes)
    out[12] = (kinds[44] + kinds[46]) / len(hashes)
    out[13] = (kinds[124] + kinds[60] + kinds[62] + kinds[95] + kinds[123] + kinds[125]) / max(1, solid)  # | < > _ { }
    out[14] = np.log1p(len(hashes)) / 10
    return out


def features(texts, n_chars) -> list[tuple[np.ndarray, np.ndarray]]:
    """(indices, values) of each text: statistics first, then hashed words, weighted by the logarithm of their counts, with a norm
    of 1. Each distinct token is hashed once."""
    texts = ["" if t is None else t for t in texts]
    codes, bounds, tokens = token_codes(texts)
    raw = [t.encode() for t in tokens]
    hashes = word_hashes(raw)
    buckets = ((word_hashes([t.lower() for t in raw]) >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)
    out = []
    for k, (text, chars) in enumerate(zip(texts, n_chars, strict=True)):
        own = codes[bounds[k] : bounds[k + 1]]
        at, n = np.unique(buckets[own], return_counts=True)
        x = np.log1p(n)
        x = x / max(1e-9, np.sqrt((x * x).sum()))
        chars = len(text) if chars is None or pd.isna(chars) else float(chars)
        out.append((np.r_[np.arange(STATISTICS), at + STATISTICS].astype(np.int32), np.r_[statistics(text.encode(), hashes[own], chars), x].astype(np.float32)))
    return out


class FactorisationMachine:
    def __init__(self, size: int = STATISTICS + BUCKETS, rank: int = RANK, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bias, self.mean, self.scale = 0.0, np.zeros(STATISTICS, np.float32), np.ones(STATISTICS, np.float32)
        self.w = np.zeros(size, np.float32)
        self.v = rng.normal(0, 0.02, (size, rank)).astype(np.float32)

    def _scaled(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        shape = at < STATISTICS
        x = x.copy()
        x[shape] = np.clip((x[shape] - self.mean[at[shape]]) / self.scale[at[shape]], -5, 5)
        return x

    def raw(self, at: np.ndarray, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Scores of rows that begin at ``first``; x is scaled."""
        vx = self.v[at] * x[:, None]
        sums = np.add.reduceat(vx, first)
        return self.bias + np.add.reduceat(self.w[at] * x, first) + 0.5 * (sums**2 - np.add.reduceat(vx**2, first)).sum(1)

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]], batch: int = 512) -> np.ndarray:
        return np.concatenate([self._score(rows[k : k + batch]) for k in range(0, len(rows), batch)] or [np.empty(0)])

    def _score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        at, x = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        first = np.r_[0, np.cumsum([len(r[0]) for r in rows])[:-1]]
        return 1 / (1 + np.exp(-np.clip(self.raw(at, self._scaled(at, x), first), -30, 30).astype(float)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.02, decay: float = 1e-5):
        shape = np.array([r[1][:STATISTICS] for r in rows])
        self.mean, self.scale = shape.mean(0), shape.std(0) + 1e-3
        self.bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        rows = [(a, self._scaled(a, x)) for a, x in rows]
        gw, gv, gb = np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6), 1e-6
        rng = np.random.default_rng(11)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for k in range(0, len(order), batch):
                part = [rows[i] for i in order[k : k + batch]]
                at, x = np.concatenate([r[0] for r in part]), np.concatenate([r[1] for r in part])
                n = np.array([len(r[0]) for r in part])
                first = np.r_[0, np.cumsum(n)[:-1]]
                vx = self.v[at] * x[:, None]
                sums = np.add.reduceat(vx, first)
                raw = self.bias + np.add.reduceat(self.w[at] * x, first) + 0.5 * (sums**2 - np.add.reduceat(vx**2, first)).sum(1)
                error = ((1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[order[k : k + batch]]) / len(part)).astype(np.float32)
                e = np.repeat(error, n)
                use, back = np.unique(at, return_inverse=True)
                dw = np.bincount(back, e * x, len(use)).astype(np.float32) + decay * self.w[use]
                dv = (e * x)[:, None] * (np.repeat(sums, n, 0) - vx)
                dv = np.stack([np.bincount(back, dv[:, f], len(use)) for f in range(dv.shape[1])], 1).astype(np.float32) + decay * self.v[use]
                gw[use] += dw**2
                gv[use] += dv**2
                gb += float(error.sum()) ** 2
                self.w[use] -= rate * 5 * dw / np.sqrt(gw[use])
                self.v[use] -= rate * dv / np.sqrt(gv[use])
                self.bias -= rate * 5 * float(error.sum()) / np.sqrt(gb)
        return self


def _features(it):
    for pdf in by_length(it):
        x = features(pdf.text, pdf.n_chars)
        yield pd.DataFrame({"doc_id": pdf.doc_id, "label": pdf.label, "at": [a for a, _ in x], "x": [v for _, v in x]})


def _input(docs: DataFrame) -> DataFrame:
    n_chars = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", n_chars.alias("n_chars"))


def fold(mod: int):
    """crc32 of the doc_id as text, modulo ``mod``; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string")) % mod


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, pairs: int = PAIRS) -> FactorisationMachine:
    """Fit on at most ``sample`` of the labelled rows (doc_id, label), the first by the hash of their id, as long as they have at most
    ``pairs`` features in all; null labels don't count, and of rows that repeat a doc_id one does, the one of the greatest text.

    Without rows of both labels, every score is the share of label 1 (a half without any row).
    """
    chosen = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most ``sample`` rows of two numbers. One row of those that repeat a doc_id, so that no more rows reach the driver.
    rows = _input(docs).join(F.broadcast(chosen), "doc_id")
    one = Window.partitionBy("doc_id").orderBy(F.desc_nulls_last("text"), F.desc_nulls_last("n_chars"))
    rows = rows.withColumn("_n", F.row_number().over(one)).where("_n = 1").select("doc_id", "label", "text", "n_chars")
    found = spill(rows.mapInPandas(_features, schema(doc_id=LONG, label=T.IntegerType(), at=T.ArrayType(T.IntegerType()), x=T.ArrayType(T.FloatType()))))
    # Sizes of at most ``sample`` rows, two numbers each, are summed in order.
    order = Window.partitionBy(F.lit(0)).orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    few = found.select("doc_id", F.sum(F.size("at")).over(order).alias("n")).where(F.col("n") <= pairs).select("doc_id")
    got = found.join(F.broadcast(few), "doc_id").select("label", "at", "x").toPandas()
    model = FactorisationMachine()
    y = got.label.to_numpy(np.float32)
    if len(y) and 0 < y.sum() < len(y):
        data = [(np.asarray(a, np.int64), np.asarray(x, np.float32)) for a, x in zip(got["at"], got["x"], strict=True)]
        order = np.lexsort(([len(a) for a, _ in data], y, [float(x[:STATISTICS].sum()) for _, x in data]))  # the same in each run
        return model.fit([data[i] for i in order], y[order])
    model.v[:] = 0
    model.bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    return model


def score(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """doc_id and score of every row. Takes doc_id, text and, where there is one, n_chars; other columns are ignored, whatever
    their names. Null texts count as empty, and empty ones are scored too; repeated rows get equal scores. An empty table gives
    an empty one."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 1.3 MB, whatever the input

    def task(it):
        for pdf in by_length(it):
            yield pd.DataFrame({"doc_id": pdf.doc_id, "score": held.value.score(features(pdf.text, pdf.n_chars))})

    return _input(docs).mapInPandas(task, schema(doc_id=LONG, score=DBL))


def filter_by_score(docs: DataFrame, model: FactorisationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score ``threshold`` or more."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def task(it):
        for batch in it:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n_chars = part.column(names.index("n_chars")).to_pylist() if "n_chars" in names else [None] * part.num_rows
                rows = features(part.column(names.index("text")).to_pylist(), n_chars)
                yield part.filter(pa.array(held.value.score(rows) >= threshold))

    return docs.mapInArrow(task, docs.schema)


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(4) != 2).select("doc_id", F.col("quality").alias("label"))
    return score(docs, train(docs, labels)).select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
