"""Substring dedup by compressed FM-indexes, one for each shard.

Each window of ``WINDOW`` words belongs to the shard of its minimizer, the least hash among the word ``GRAM``-grams within,
so equal windows always meet. Consecutive windows with one minimizer travel as one segment. A window whose minimizer occurs
once in the corpus occurs once itself; only segments of repeated minimizers are shipped. A shard indexes its segments and
streams them through backward search over a wavelet matrix, reporting maximal intervals whose words occur at least twice.
"""

from __future__ import annotations

import hashlib
from itertools import chain, compress

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BIN, BOOL, INT, LONG, STR, gram_hashes, partitions, schema, signed, spill, token_codes, word_hashes

WINDOW = 35
GRAM = 8
#: Minimizers that occur more often are hot: their windows must also have a repeated hash before they are shipped.
HOT = 100
#: Words of the grams whose least hash deals out windows of hot minimizers again.
FINE_GRAM = 24
#: Words of segments in one index.
INDEX_WORDS = 400_000
#: Words of a probe: after a failure, so many are looked up before all windows that hold them are tried.
PROBE = 8


#: The bits below each bit of a word.
BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


def minimizer_runs(raw: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, first window, windows) of each run of consecutive windows with one minimizer place; the leftmost wins ties."""
    if len(raw) < window:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none
    h = gram_hashes(word_hashes(raw), gram)
    width = window - gram + 1
    at = np.empty(len(h) - width + 1, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(h, width)
    for a in range(0, len(at), 1 << 14):
        at[a : a + (1 << 14)] = view[a : a + (1 << 14)].argmin(1)
    at += np.arange(len(at))
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return h[at[first]], first, np.diff(np.r_[first, len(at)])


class WaveletIndex:
    """FM-index of an integer text: its Burrows-Wheeler transform in a wavelet matrix with rank directories.

    Suffixes are sorted by their first 64 symbols, which is exact for patterns of up to 64.
    """

    def __init__(self, text: np.ndarray):
        n = self.n = len(text)
        sigma = int(text.max()) + 1
        rank, step = text.astype(np.int64), 1
        while True:
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            key = rank * (n + 2 + sigma) + after
            order = np.argsort(key, kind="stable")
            new = np.cumsum(np.r_[False, key[order][1:] != key[order][:-1]])
            rank = np.empty(n, np.int64)
            rank[order] = new
            step *= 2
            if step >= 64 or new[-1] == n - 1:
                break
        bwt = text[order - 1]  # -1 wraps to the last symbol
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=sigma))].astype(np.int32)
        self.depth = max(1, (sigma - 1).bit_length())
        self.levels = []
        for bit in reversed(range(self.depth)):
            ones = (bwt >> bit) & 1
            packed = np.packbits(np.r_[ones, np.zeros(64 + -n % 64, ones.dtype)].astype(np.uint8), bitorder="little").view(np.uint64)
            directory = np.r_[0, np.cumsum(np.bitwise_count(packed).astype(np.int32))].astype(np.int32)
            zeros = np.int32(n - int(ones.sum()))
            self.levels.append((bit, packed, directory, zeros))
            bwt = np.concatenate([bwt[ones == 0], bwt[ones == 1]])
        self.base = self._walk(np.arange(sigma, dtype=np.int32), np.zeros(sigma, np.int32))
        self.shift = self.first[:sigma] - self.base

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, packed, directory, zeros in self.levels:
            word = at >> 6
            ones = np.bitwise_count(packed[word] & BELOW[at & 63]) + directory[word]
            at = np.where(symbol & (1 << bit), ones + zeros, at - ones)
        return at

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of symbol + pattern, for the intervals of many patterns."""
        k = len(symbol)
        both = self._walk(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        shift = self.shift[symbol]
        return both[:k] + shift, both[k:] + shift


class _Numbers(dict):
    """Numbers from 1 for distinct words."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self) + 1
        return n


def repeated_intervals(segments: list[str], weights: list[int], window: int, probe: int = PROBE) -> list[list[int]]:
    """For each segment: [start, end, ...] of word intervals all of whose windows occur twice or more among all segments.

    A segment with a weight of 2 or more stands for as many occurrences: it is indexed twice, and all its windows are repeated.
    """
    words = [s.split("\x20") for s in segments]
    size = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(size + 1) - (size + 1)
    # Words are numbered from 1; 0, which no word has, follows each segment.
    text = np.zeros(int((size + 1).sum()), np.int64)
    text[np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)] = np.fromiter(map(_Numbers().__getitem__, chain.from_iterable(words)), np.int64, int(size.sum()))
    several = np.asarray(weights) > 1
    index = WaveletIndex(np.r_[0, text, text[np.repeat(several, size + 1)]])
    out: list[list[int]] = [[] for _ in segments]
    for k in np.flatnonzero((size >= window) & several):
        out[k] = [0, int(size[k])]
    # Matching statistics from the right, all segments in step: words [left, right) of a segment have the interval [lo, hi).
    # All windows that end beyond ``right`` are settled, and so are those that begin at ``left`` or later.
    who = np.flatnonzero((size >= window) & ~several)
    stream = text.astype(np.int32)
    right, left = size[who].copy(), size[who].copy()
    lo, hi = np.zeros(len(who), np.int32), np.full(len(who), index.n, np.int32)
    goal, then = np.full(len(who), -1), np.zeros(len(who), np.int64)  # where a probe ends, and what follows if all of it occurs
    while len(who):
        a, b = index.extend(stream[begin[who] + left - 1], lo, hi)
        grew = b - a >= 2
        left = left - grew
        lo, hi = np.where(grew, a, lo), np.where(grew, b, hi)
        probing = goal >= 0
        stop = ~grew | (left == 0) | (left == goal)
        if not stop.any():
            continue
        for k in np.flatnonzero(stop & ~probing & (right - left >= window)):
            out[who[k]] += [int(left[k]), int(right[k])]
        # The next window to try ends before the word that failed, or begins one to the left of the interval.
        next_ = np.where(right - left >= window, left + window - 1, right - 1)
        # All windows left hold the word that failed and those after it: if few of these don't occur, none of the windows does.
        tries = stop & ~probing & (left > 0) & (left - 1 + probe < next_)
        done = stop & probing
        passed = done & grew
        start = np.where(tries, left - 1 + probe, np.where(passed, then, np.where(done, right - 1, np.where(left == 0, 0, next_))))
        goal, then = np.where(tries, left - 1, np.where(stop, -1, goal)), np.where(tries, next_, then)
        right, left = np.where(stop, start, right), np.where(stop, start, left)
        lo, hi = np.where(stop, np.int32(0), lo), np.where(stop, np.int32(index.n), hi)
        go = ~stop | (goal >= 0) | (right >= window)
        who, right, left, lo, hi, goal, then = (x[go] for x in (who, right, left, lo, hi, goal, then))
    return out


def _runs(window: int, gram: int):
    def task(it):
        for pdf in it:
            doc, th, fp, start, count = [], [], [], [], []
            for d, t, x in zip(pdf.doc_id, pdf.th, pdf.text, strict=True):
                m, first, n = minimizer_runs(x.encode().split(), window, gram)
                doc.append(np.full(len(m), d)), th.append(np.full(len(m), t)), fp.append(signed(m)), start.append(first), count.append(n)
            if doc:
                yield pd.DataFrame({"doc_id": np.concatenate(doc), "th": np.concatenate(th), "fp": np.concatenate(fp), "start": np.concatenate(start).astype(np.int32), "n": np.concatenate(count).astype(np.int32)})

    return task


def _pack(it):
    squeeze = zstandard.ZstdCompressor(3)
    for pdf in it:
        yield pdf.assign(text=[squeeze.compress(x.encode()) for x in pdf.text])


def _words(blob: bytes, memory=zstandard.ZstdDecompressor()) -> list[bytes]:  # noqa: B008
    return memory.decompress(blob).split()


def _cut(window: int):
    """Rows of documents with their repeated minimizers, to rows of segments."""

    def task(it):
        for pdf in it:
            n_runs, segments, hashes = [], [], []
            for blob, start, n, hot in zip(pdf.text, pdf.start, pdf.n, pdf.hot, strict=True):
                words = _words(blob)
                line = b" ".join(words)
                begin = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                whole = signed(gram_hashes(word_hashes(words), window)) if hot.any() else None
                first = np.r_[0, begin][start].tolist()
                last = (begin[start + n + window - 2] - 1).tolist()
                segments += [line[i:j].decode() for i, j in zip(first, last, strict=True)]
                hashes += [whole[i : i + k] if h else None for i, k, h in zip(start.tolist(), n.tolist(), hot.tolist(), strict=True)]
                n_runs.append(len(start))
            every = lambda c: np.concatenate(c.tolist()) if n_runs else []  # noqa: B023, E731
            yield pd.DataFrame({"doc_id": np.repeat(pdf.doc_id.to_numpy(), n_runs), "th": np.repeat(pdf.th.to_numpy(), n_runs), "fp": every(pdf.fp), "hot": every(pdf.hot), "start": every(pdf.start), "segment": segments, "hashes": hashes})

    return task


def _narrow(window: int, fine: int):
    """Hot segments, cut down to the runs of windows with repeated hashes, and dealt out by a second minimizer of longer grams, so
    that a phrase in very many passages doesn't bring them all to one shard. Equal windows have equal second minimizers too."""

    def task(it):
        for pdf in it:
            if not len(pdf):
                continue
            # All segments of a batch in one row of words; places of windows are counted through it.
            codes, bounds, tokens = token_codes(pdf.segment)
            raw = [t.encode() for t in tokens]
            grams = gram_hashes(word_hashes(raw)[codes], fine)
            at = np.unique(np.concatenate([b + p for b, p in zip(bounds[:-1], pdf.places, strict=True)]))
            row = np.searchsorted(bounds, at, "right") - 1
            least = at + np.lib.stride_tricks.sliding_window_view(grams, window - fine + 1)[at].argmin(1)
            first = np.flatnonzero(np.r_[True, (np.diff(at) > 1) | (np.diff(row) > 0) | (np.diff(least) != 0)])
            last = at[np.r_[first[1:], len(at)] - 1] + window - 1
            least, row, first = least[first], row[first], at[first]
            line = "\x20".join(pdf.segment).encode()
            size = np.fromiter(map(len, raw), np.int64, len(raw))[codes]
            end = np.cumsum(size + 1) - 1
            parts = [line[i:j].decode() for i, j in zip((end - size)[first].tolist(), end[last].tolist(), strict=True)]
            fp = signed(grams[least] ^ pdf.fp.to_numpy()[row].view(np.uint64))
            yield pd.DataFrame({"doc_id": pdf.doc_id.to_numpy()[row], "th": pdf.th.to_numpy()[row], "fp": fp, "start": (pdf.start.to_numpy()[row] + first - bounds[row]).astype(np.int32), "segment": parts})

    return task


def _combine(it):
    """Equal segments of a batch become one row, before the shuffle."""
    for pdf in it:
        yield pdf.groupby(["fp", "sh", "segment"], sort=False, as_index=False).agg(weight=("weight", "sum"))


def _search(window: int, index_words: int):
    def task(it):
        def flush(rows):
            known: dict = {}
            for fp, sh, seg, w in rows:
                known[fp, sh, seg] = known.get((fp, sh, seg), 0) + w
            found = repeated_intervals([k[2] for k in known], list(known.values()), window)
            hits = [(k[0], k[1], f) for k, f in zip(known, found, strict=True) if f]
            return pd.DataFrame(hits, columns=["fp", "sh", "found"])

        rows, held = [], 0
        for pdf in it:
            for row in zip(pdf.fp, pdf.sh, pdf.segment, pdf.weight, strict=True):
                if held >= index_words and row[0] != rows[-1][0]:  # all segments of a minimizer share an index
                    yield flush(rows)
                    rows, held = [], 0
                rows.append(row)
                held += row[2].count("\x20") + 1
        if rows:
            yield flush(rows)

    return task


def _remove(it):
    for pdf in it:
        rows = []
        for d, blob, found in zip(pdf.doc_id, pdf.text, pdf.found, strict=True):
            words = _words(blob)
            keep = np.ones(len(words), bool)
            spans = []
            if found is not None:
                for a, b in found.reshape(-1, 2).tolist():
                    keep[a:b] = False
                edge = np.flatnonzero(np.diff(np.r_[False, ~keep, False].astype(np.int8)))
                spans = edge.tolist()
            kept = b" ".join(compress(words, keep))
            rows.append((d, len(words), int((~keep).sum()), spans, kept.decode()))
        yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "spans", "kept_text"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, index_words: int = INDEX_WORDS, fine: int = FINE_GRAM) -> DataFrame:
    """Remove every word covered by a window of words that also starts anywhere else.

    Takes ``doc_id`` and ``text`` of ``docs``; other columns are ignored, whatever their names. Returns one row per input row:
    doc_id, n_words, n_removed, spans ([start, end, ...] of removed words), kept_text. A null or empty text, or one without
    words, has 0 words and an empty kept text; one shorter than a window loses nothing; a row that appears twice loses all its
    windows; a null doc_id is kept as it is. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    none = -(1 << 63)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(none)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("th", F.xxhash64("text"))
    shards = partitions(spark)
    runs = spill(docs.mapInPandas(_runs(window, gram), schema(doc_id=LONG, th=LONG, fp=LONG, start=INT, n=INT)))
    # Written, so that the join deals out both sides anew and Spark can split the rows of a hot minimizer.
    counts = spill(runs.groupBy("fp").agg(F.count("*").alias("times")).where("times > 1").select("fp", (F.col("times") > hot).alias("hot")))
    wanted = runs.join(counts, "fp").groupBy("doc_id", "th").agg(F.collect_set(F.struct("fp", "start", "n", "hot")).alias("runs"))
    packed = docs.mapInPandas(_pack, schema(doc_id=LONG, text=BIN, th=LONG))
    listed = packed.join(wanted, ["doc_id", "th"]).select("doc_id", "th", "text", "runs.fp", "runs.start", "runs.n", "runs.hot")
    segments = spill(listed.mapInPandas(_cut(window), schema(doc_id=LONG, th=LONG, fp=LONG, hot=BOOL, start=INT, segment=STR, hashes=T.ArrayType(LONG))))

    part = segments.where("hot")
    hashes = part.select("doc_id", "th", "start", F.posexplode("hashes").alias("place", "wh"))
    twice = spill(hashes.groupBy("wh").agg(F.count("*").alias("times")).where("times > 1").select("wh"))
    # A row that appears twice has each place twice.
    places = hashes.join(twice, "wh", "left_semi").groupBy("doc_id", "th", "start").agg(F.collect_set("place").alias("places"))
    narrowed = part.select("doc_id", "th", "fp", "start", "segment").join(places, ["doc_id", "th", "start"])
    narrowed = spill(narrowed.select("doc_id", "th", "fp", "start", "segment", "places").mapInPandas(_narrow(window, min(fine, window)), schema(doc_id=LONG, th=LONG, fp=LONG, start=INT, segment=STR)))
    segments = segments.where("not hot").select("doc_id", "th", "fp", "start", "segment").union(narrowed).withColumn("sh", F.xxhash64("segment"))

    rows = segments.select("fp", "sh", "segment", F.lit(1).cast("long").alias("weight")).mapInPandas(_combine, schema(fp=LONG, sh=LONG, segment=STR, weight=LONG))
    found = rows.repartition(shards, "fp").sortWithinPartitions("fp").mapInPandas(_search(window, index_words), schema(fp=LONG, sh=LONG, found=T.ArrayType(INT)))
    by_doc = segments.select("doc_id", "th", "fp", "sh", "start").join(found, ["fp", "sh"]).groupBy("doc_id", "th").agg(F.flatten(F.collect_list(F.transform("found", lambda at: at + F.col("start")))).alias("found"))
    out = packed.join(by_doc, ["doc_id", "th"], "left").select("doc_id", "text", "found").mapInPandas(_remove, schema(doc_id=LONG, n_words=LONG, n_removed=LONG, spans=T.ArrayType(INT), kept_text=STR))
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(none)))


def op1(spark, sf_dir: str) -> DataFrame:
    kept = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT r, p, array_to_string(w[p:p + 34], ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)
), twice AS (SELECT x FROM windows GROUP BY x HAVING count(*) > 1
), gone AS (SELECT DISTINCT r, unnest(range(p, p + 35)) AS q FROM windows SEMI JOIN twice USING (x)
), words AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM d
), kept AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY q) AS t FROM words ANTI JOIN gone USING (r, q) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""


def brute_force(texts: list[str | None], window: int = WINDOW) -> list[tuple[int, int, str]]:
    """The same by counting all windows in memory, for tests."""
    from collections import Counter

    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                keep[i : i + window] = [False] * window
        kept = b" ".join(compress(w, keep))
        out.append((len(w), len(w) - sum(keep), hashlib.sha256(kept).hexdigest()))
    return out
