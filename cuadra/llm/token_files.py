"""Token files of directly addressable codes.

A file holds the ids of a range of documents in ascending doc_id order. Each id is split into 8-bit chunks, the lowest first;
level j holds the j-th chunk of all ids that have one, a continuation bitmap tells which ids go on to level j + 1, and a rank
directory over that bitmap gives an id's place there. Any token is read by one rank per level, without decoding a block.

Layout, little endian: magic ``DAC1``, levels u32, documents u64, tokens u64; (documents + 1) u64 offsets; then per level u64
length, the chunk bytes, the bitmap as u64 words and the directory as u32 counts of ones before every word.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BIN, INT, LONG, schema, shared_dir
from .tokens import END, encoder, vocabulary_path

MAGIC = b"DAC1"
CHUNK = 8
#: Tokens in one file, about; a document isn't split over files.
FILE_TOKENS = 1_000_000
#: Tokens that are looked up at once.
READ = 1 << 16
#: Each bit of a word, and the bits below it.
BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)
BELOW = BIT - np.uint64(1)


def write_codes(ids: np.ndarray, offsets: np.ndarray) -> bytes:
    """The bytes of a file for the ids of documents that begin at ``offsets`` (one more than documents)."""
    levels, x = [], ids.astype(np.uint64)
    while len(x) or not levels:
        more = x >> np.uint64(CHUNK)
        goes_on = more > 0
        bits = np.packbits(np.r_[goes_on, np.zeros(64 + -len(x) % 64, bool)].astype(np.uint8), bitorder="little").view("<u8")
        directory = np.r_[0, np.cumsum(np.bitwise_count(bits).astype(np.uint32))[:-1]].astype("<u4")
        levels.append(np.uint64(len(x)).tobytes() + (x & np.uint64(255)).astype(np.uint8).tobytes() + bits.tobytes() + directory.tobytes())
        x = more[goes_on]
    head = MAGIC + np.uint32(len(levels)).tobytes() + np.uint64(len(offsets) - 1).tobytes() + np.uint64(len(ids)).tobytes()
    return head + offsets.astype("<u8").tobytes() + b"".join(levels)


class Codes:
    """Reads a file; ``codes[i]`` and ``codes.at(places)`` are random access to any tokens."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a token file")
        n_levels, docs, self.tokens = int(np.frombuffer(blob, "<u4", 1, 4)[0]), *np.frombuffer(blob, "<u8", 2, 8).tolist()
        self.offsets = np.frombuffer(blob, "<u8", docs + 1, 24).astype(np.int64)
        at = 24 + 8 * (docs + 1)
        self.levels = []
        for _ in range(n_levels):
            n = int(np.frombuffer(blob, "<u8", 1, at)[0])
            words = (n + 64 + -n % 64) // 64
            at += 8
            chunks = np.frombuffer(blob, np.uint8, n, at)
            bits = np.frombuffer(blob, "<u8", words, at + n)
            directory = np.frombuffer(blob, "<u4", words, at + n + 8 * words)
            at += n + 12 * words
            self.levels.append((chunks, bits, directory))

    def at(self, places: np.ndarray) -> np.ndarray:
        places = np.asarray(places, np.int64)
        if len(places) and (places.min() < 0 or places.max() >= self.tokens):
            raise IndexError("no such token")
        out = np.zeros(len(places), np.uint32)
        who = None
        for j, (chunks, bits, directory) in enumerate(self.levels):
            if who is None:
                out[:] = chunks[places]
            else:
                out[who] |= chunks[places].astype(np.uint32) << np.uint32(CHUNK * j)
            if j + 1 == len(self.levels):
                break
            at = places >> 6
            word, bit = bits[at], places & 63
            below = word & BELOW[bit]
            goes_on = np.flatnonzero(word & BIT[bit])
            # The rank of an id among those that go on is its place in the next level.
            places = (directory[at] + np.bitwise_count(below))[goes_on].astype(np.int64)
            who = goes_on if who is None else who[goes_on]
            if not len(who):
                break
        return out

    def __getitem__(self, i: int) -> int:
        return int(self.at(np.array([i]))[0])

    def between(self, first: int, last: int) -> np.ndarray:
        """Tokens from ``first`` up to ``last``, without it."""
        return np.concatenate([self.at(np.arange(k, min(k + READ, last))) for k in range(first, last, READ)] or [np.empty(0, np.uint32)])

    def document(self, k: int) -> np.ndarray:
        return self.between(int(self.offsets[k]), int(self.offsets[k + 1]))


def _write(path: str, file_tokens: int):
    def task(it):
        def file(bucket, number, before, held):
            lengths = np.array([len(x) for _, x in held])
            ids = np.concatenate([x for _, x in held])
            return {"bucket": bucket, "number": number, "before": before, "documents": [d for d, _ in held], "tokens": len(ids), "codes": write_codes(ids, np.r_[0, np.cumsum(lengths)])}

        number, before, held, tokens = 0, 0, [], 0
        bucket = None
        for pdf in it:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                files = []
                for b, d, ids in zip(part.bucket, part.doc_id, encoder(path).encode(part.text.tolist()), strict=True):
                    bucket = b
                    if held and tokens >= file_tokens:
                        files.append(file(bucket, number, before, held))
                        number, before, held, tokens = number + 1, before + tokens, [], 0
                    held.append((None if pd.isna(d) else int(d), np.append(ids, np.uint32(END))))
                    tokens += len(ids) + 1
                if files:
                    yield pd.DataFrame(files)
        if held:
            yield pd.DataFrame([file(bucket, number, before, held)])

    return task


#: ``bucket`` and ``number`` give the order of files; ``before`` are the tokens of the files before it in its bucket.
FILES = schema(bucket=INT, number=INT, before=LONG, documents=T.ArrayType(LONG), tokens=LONG, codes=BIN)


def write_token_files(docs: DataFrame, to: str, path: str | None = None, file_tokens: int = FILE_TOKENS) -> None:
    """Tokenize ``docs``, append the end id to each and write the files, in ascending doc_id order, to the folder ``to``.

    Takes ``doc_id`` and ``text``; other columns are ignored, whatever their names. A null text counts as empty; null doc_ids
    come first; rows that repeat a doc_id are ordered by text. Files are rows of a Parquet folder (``bucket`` and ``number`` give
    their order), so that any store Spark writes to will do. An empty table gives an empty folder.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = docs.repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    ordered.select(F.spark_partition_id().alias("bucket"), "doc_id", "text").mapInPandas(_write(path or vocabulary_path(), file_tokens), FILES).write.option("compression", "uncompressed").parquet(to)


def _read(it):
    for pdf in it:
        for start, documents, blob in zip(pdf.start, pdf.documents, pdf.codes, strict=True):
            codes = Codes(blob)
            o = codes.offsets
            ids = codes.between(0, codes.tokens).astype("<u4")  # each by its ranks
            rows = [(d, start + a, b - a, zlib.crc32(ids[a:b])) for d, a, b in zip(documents, o[:-1].tolist(), o[1:].tolist(), strict=True)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})


def read_token_files(spark, at: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.schema(FILES).parquet(at)
    # Files know the tokens before them in their bucket; totals of buckets, of which there are as many as tasks wrote, are broadcast.
    buckets = files.groupBy("bucket").agg(F.sum("tokens").alias("n"))
    before = buckets.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("start"))
    placed = files.join(F.broadcast(before), "bucket").select((F.col("start") + F.col("before")).alias("start"), "documents", "codes")
    return placed.mapInPandas(_read, schema(doc_id=LONG, start=LONG, n_tokens=LONG, ids_crc32=LONG))


def op8(spark, sf_dir: str) -> DataFrame:
    to = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), to)
    return read_token_files(spark, to)
