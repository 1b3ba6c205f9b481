"""Periodic runs: stretches of a text that repeat their first words, found on a harmonic grid and collapsed to one period.

A run of period q and at least 2 q words covers a multiple of q, so for each period the grid points 0, q, 2 q ... are enough, about
n ln n of them. How far the words at a point and q later agree, forwards and backwards, is found by binary search over prefix hashes,
for all points of many texts at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROLL, mix, table, token_codes

#: Words of the shortest run.
LEAST = 12
#: Grid points that are looked at together, and bytes of text; a longer text is looked at by itself.
POINTS, BYTES = 1 << 20, 1 << 22
RUNS = "array<struct<start: long, length: long, period: long>>"
SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _spread(counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers 0 to count - 1 of each item, and the items they are of, POINTS at a time."""
    ends = np.cumsum(counts)
    begins = ends - counts
    for at in range(0, int(ends[-1]) if len(ends) else 0, POINTS):
        to = min(at + POINTS, int(ends[-1]))
        a, b = np.searchsorted(ends, at, side="right"), np.searchsorted(ends, to - 1, side="right") + 1
        item = np.repeat(np.arange(a, b), np.minimum(ends[a:b], to) - np.maximum(begins[a:b], at))
        yield np.arange(at, to) - begins[item], item


def _grid(begin: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, period, grid point) of all texts: periods up to half the text, points from which the word a period later exists."""
    for k, text in _spread(size // 2):
        for j, item in _spread((size[text] - 1) // (k + 1)):
            q = k[item] + 1
            yield text[item], q, begin[text[item]] + j * q


class _Prefixes:
    """Prefix sums of hashed words times powers, modulo 2^64: equal stretches have equal differences, up to the power between them."""

    def __init__(self, codes: np.ndarray):
        self.power = np.cumprod(np.r_[np.uint64(1), np.full(len(codes), ROLL, np.uint64)])
        self.sums = np.r_[np.uint64(0), np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * self.power[:-1])]

    def equal(self, i: np.ndarray, q: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether ``length`` words from ``i`` on are those from ``i`` + q on."""
        return (self.sums[i + length] - self.sums[i]) * self.power[q] == self.sums[i + q + length] - self.sums[i + q]

    def extension(self, i: np.ndarray, q: np.ndarray, most: np.ndarray, forwards: bool) -> np.ndarray:
        """Up to ``most`` words on from ``i``, or before it, that are equal to those q later."""
        low, high = np.zeros_like(most), most.copy()
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_] + 1) >> 1
            at = i[open_] if forwards else i[open_] - middle
            same = self.equal(at, q[open_], middle)
            low[open_] = np.where(same, middle, low[open_])
            high[open_] = np.where(same, high[open_], middle - 1)
        return low


def find_runs(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Runs of texts given as numbered words: rows (text, start, length, period) by text, start, period; starts count in the text.

    A run is a stretch with smallest period q, of at least 2 q and LEAST words, that doesn't go on in period q on either side.
    """
    begin, size = bounds[:-1], np.diff(bounds)
    some = np.flatnonzero(size >= LEAST)
    if not len(some):
        return np.empty((0, 4), np.int64)
    prefixes = _Prefixes(codes)
    found = []
    for text, q, i in _grid(begin[some], size[some]):
        keep = np.flatnonzero(codes[i] == codes[i + q])
        text, q, i = some[text[keep]], q[keep], i[keep]
        # Where the grid point before agrees up to here, its run is this one.
        before = np.flatnonzero(i - q >= begin[text])
        new = np.ones(len(i), bool)
        new[before] = ~prefixes.equal(i[before] - q[before], q[before], q[before])
        text, q, i = text[new], q[new], i[new]
        ahead = prefixes.extension(i, q, begin[text] + size[text] - i - q, True)
        back = prefixes.extension(i, q, i - begin[text], False)
        long = ahead + back + q >= np.maximum(LEAST, 2 * q)
        found.append(np.stack([text, i - back, i + q + ahead, q], 1)[long])
    runs = np.unique(np.concatenate(found), axis=0)
    least = _least(runs)
    odd = runs[runs[:, 3] % runs[least, 3] != 0, 0]
    runs = runs[least == np.arange(len(runs))]
    wrong = np.unique(np.r_[odd, runs[~_verified(codes, bounds, runs), 0]])
    if len(wrong):  # hashes that agree by chance: these texts are compared word by word
        runs = np.concatenate([runs[~np.isin(runs[:, 0], wrong)], *(_word_by_word(codes, bounds, t) for t in wrong)])
    runs = runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]
    return np.stack([runs[:, 0], runs[:, 1] - begin[runs[:, 0]], runs[:, 2] - runs[:, 1], runs[:, 3]], 1)


def _least(runs: np.ndarray) -> np.ndarray:
    """For each of the sorted rows (text, start, end, period) the place of the first one of its stretch, which has the least period.
    A stretch has further periods that it keeps as far: multiples of the least one, since their greatest common divisor is one too."""
    new = np.r_[True, (runs[1:, :3] != runs[:-1, :3]).any(1)][: len(runs)]
    return np.flatnonzero(new)[np.cumsum(new) - 1]


def _verified(codes: np.ndarray, bounds: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Whether the words of each run are those a period later, and the words around it aren't."""
    text, start, end, q = runs.T
    good = np.ones(len(runs), bool)
    for j, item in _spread(end - start - q):
        at = start[item] + j
        good[item[codes[at] != codes[at + q[item]]]] = False
    inner = np.flatnonzero(start > bounds[text])
    good[inner[codes[start[inner] - 1] == codes[start[inner] - 1 + q[inner]]]] = False
    inner = np.flatnonzero(end < bounds[text + 1])
    good[inner[codes[end[inner]] == codes[end[inner] - q[inner]]]] = False
    return good


def _word_by_word(codes: np.ndarray, bounds: np.ndarray, text: int) -> np.ndarray:
    a, b = int(bounds[text]), int(bounds[text + 1])
    found = [np.empty((0, 4), np.int64)]
    for q in range(1, (b - a) // 2 + 1):
        same = np.diff(np.r_[0, (codes[a : b - q] == codes[a + q : b]).astype(np.int8), 0])
        start, end = a + np.flatnonzero(same == 1), a + np.flatnonzero(same == -1) + q
        found.append(np.stack([np.full(len(start), text), start, end, np.full(len(start), q)], 1)[end - start >= max(LEAST, 2 * q)])
    runs = np.unique(np.concatenate(found), axis=0)
    return runs[_least(runs) == np.arange(len(runs))]


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about BYTES of text; a longer text is a piece of its own."""
    piece = (np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)) - 1) // BYTES
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(batch)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in _pieces(batch):
            codes, bounds, words = token_codes(piece["text"])
            runs = find_runs(codes, bounds)
            text, start, length, q = runs.T
            change = np.zeros(len(codes) + 1, np.int64)
            np.add.at(change, bounds[text] + start + q, 1)
            np.add.at(change, bounds[text] + start + length, -1)
            kept = np.cumsum(change)[:-1] == 0
            names = np.array(words, object)
            texts = [" ".join(names[codes[a:b][kept[a:b]]].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            spans = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, q)], fields=list(SPAN))
            ends = np.r_[0, np.cumsum(np.bincount(text, minlength=len(piece)))]
            yield pa.RecordBatch.from_pydict({"doc_id": piece["doc_id"], "n_words": pa.array(np.diff(bounds), pa.int64()), "runs": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans), "text": pa.array(texts, pa.string())})


def collapse_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start, then period) and the text without the words that a run
    repeats: of every run its first ``period`` words stay. Words are what stands between blanks, tabs and line breaks; the text has
    them joined by one blank.

    A row for each row, in any order: null ids and ids that repeat are kept as they are. Null, empty and wordless texts have no words,
    no runs and an empty text. Texts are read whole, however long.
    """
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_collapsed, f"doc_id long, n_words long, runs {RUNS}, text string")


def looped(docs: DataFrame) -> DataFrame:
    """doc_id and text; where the CRC of the id ends in 0, the words from the a-th on repeat the p that follow it."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def repeated(w):
        n, g = F.size(w), F.floor(h / 10)
        a = (g % F.greatest(n, F.lit(1))).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.when(n > 0, F.concat_ws(" ", F.slice(w, F.lit(1), a), F.transform(F.sequence(F.lit(0), n - a - 1), lambda i: F.get(w, a + i % p))))

    # The array of one binds the words to a name, so they are split once.
    edited = F.get(F.transform(F.array(words), repeated), 0)
    return docs.select("doc_id", F.when(h % 10 == 0, F.coalesce(edited, "text")).otherwise(F.col("text")).alias("text"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, a tenth of them edited to repeat, and digests of runs and of collapsed texts."""
    found = collapse_runs(looped(table(spark, sf_dir, "documents").select("doc_id", "text")))
    first = F.get(F.array_sort("runs", lambda a, b: F.when(a["length"] != b["length"], F.signum(b["length"] - a["length"])).when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(a["period"] - b["period"])).cast("int")), 0)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    found = found.withColumns({"longest": first, "runs_sha256": F.sha2(lines.cast("binary"), 256), "collapsed_sha256": F.sha2(F.col("text").cast("binary"), 256)})
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "longest.start", "longest.length", "longest.period", F.floor(1000 * F.col("longest.length") / F.col("longest.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
