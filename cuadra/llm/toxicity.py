"""Toxicity by class-conditional Kneser-Ney models of words.

Each class has a bigram model of its own, counted in labelled rows, with modified Kneser-Ney discounts: bigrams, then continuation
counts of the class (in how many contexts a word follows), then counts that both classes share (in how many documents of the whole
corpus a word occurs), so that rare expressions are smoothed alike. A document is judged by its length-normalised log-likelihood
ratio, toxic against ordinary, and by the ratios of its most toxic words in the lower order, where single sightings weigh little.

The shared counts are a table of all words of all documents, kept in Spark; it grows with the corpus. Only its rows for words of
the labelled sample enter the model: for any other word both classes back off to the same shared count, which cancels out.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import DBL, INT, LONG, STR, by_length, schema, signed, spill, token_codes, word_hashes
from .quality import fold

#: Labelled rows of each class that are learnt from, at most, and their characters; no row may have over an eighth of these.
SAMPLE, SAMPLE_CHARS = 15_000, 800_000
#: Each labelled row is calibrated on by a model that hasn't seen its fold.
FOLDS = 4
THRESHOLD = 0.7
FEATURES = 5
#: What separates words within a line.
BETWEEN = re.compile(r"[^\w\n]+")
#: The context of a document's first word; not a word itself.
BEGIN = "\x02"


def _words(tokens: list[str]) -> list[list[str]]:
    """The lower-cased words of each token."""
    return [x.split() for x in BETWEEN.sub(" ", "\n".join(tokens).lower()).split("\n")] if tokens else []


def sequences(texts) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of many texts, the words of all texts by their places among these, and where each text begins and the last ends."""
    codes, bounds, tokens = token_codes(texts)
    found = _words(tokens)
    index: dict[str, int] = {}
    at = np.array([index.setdefault(w, len(index)) for x in found for w in x], np.int64)
    n = np.fromiter(map(len, found), np.int64, len(found))
    first, many = np.cumsum(n) - n, n[codes]
    ends = np.cumsum(many)
    said = at[np.arange(many.sum()) + np.repeat(first[codes] - ends + many, many)]
    return list(index), said, np.r_[0, ends][bounds]


def _hashes(words: list[str]) -> np.ndarray:
    return signed(word_hashes([w.encode() for w in words]))


def _vocabulary(it):
    """(word, hash, documents): in how many rows each word occurs."""
    for pdf in by_length(it):
        words, said, bounds = sequences(pdf.text)
        doc = np.repeat(np.arange(len(pdf)), np.diff(bounds))
        each = np.unique(doc * max(1, len(words)) + said) % max(1, len(words))
        if words:
            yield pd.DataFrame({"word": words, "hash": _hashes(words), "documents": np.bincount(each, minlength=len(words))})


def _bigrams(it):
    """(v, w, label, fold, n): counts of word w after v, by their hashes."""
    begin = _hashes([BEGIN])[0]
    for pdf in by_length(it):
        words, said, bounds = sequences(pdf.text)
        w = _hashes(words)[said]
        v = np.r_[begin, w[:-1]] if len(w) else w
        v[bounds[:-1][np.diff(bounds) > 0]] = begin
        rows = np.repeat(np.arange(len(pdf)), np.diff(bounds))
        yield pd.DataFrame({"v": v, "w": w, "label": pdf.label.to_numpy()[rows], "fold": pdf.fold.to_numpy()[rows]}).groupby(["v", "w", "label", "fold"], as_index=False).size().rename(columns={"size": "n"})


def _find(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places in a sorted array; -1 for what it doesn't hold."""
    if not len(known):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return np.where(known[at] == wanted, at, -1)


def discounts(n: np.ndarray) -> np.ndarray:
    """What is taken from each count: less than the count, by how many counts of one to four there are, for one, two and more."""
    one, two, three, four = np.maximum(1, np.bincount(np.minimum(n, 5), minlength=6)[1:5])
    y = one / (one + 2 * two)
    d = np.clip([1 - 2 * y * two / one, 2 - 3 * y * three / two, 3 - 4 * y * four / three], 0.1, [1, 2, 3])
    return np.append(0.0, d)[np.minimum(n, 3)]


class KneserNey:
    """Both classes' models, of counts (v, w, toxic, ordinary) and of the shared ones: ``documents`` of sorted ``words``, ``total``."""

    def __init__(self, v: np.ndarray, w: np.ndarray, counts: list[np.ndarray], words: np.ndarray, documents: np.ndarray, total: int):
        self.words = np.unique(np.concatenate([v, w]))
        size = len(self.words)
        at_v, at_w = np.searchsorted(self.words, v), np.searchsorted(self.words, w)
        keys = at_v * size + at_w
        order = np.argsort(keys)
        self.keys = keys[order]
        known = _find(words, self.words)
        shared = np.where(known >= 0, documents[known] if len(documents) else 0, 1) / max(1, total)
        # By class: discounted bigrams; what contexts leave to lower orders; words without a context; what these leave to shared counts.
        self.own, self.left, self.below, self.unseen = [], [], [], []
        for n in counts:
            taken = discounts(n)
            context = np.bincount(at_v, n, size)
            before = np.bincount(at_w[n > 0], minlength=size)
            pairs = max(1, int(before.sum()))
            unseen = discounts(before).sum() / pairs if before.any() else 1.0
            with np.errstate(divide="ignore", invalid="ignore"):
                self.left.append(np.where(context > 0, np.bincount(at_v, taken, size) / context, 1.0))
                self.own.append(np.where(n > 0, (n - taken) / context[at_v], 0.0)[order])
            self.below.append((before - discounts(before)) / pairs + unseen * shared)
            self.unseen.append(unseen)

    def probabilities(self, at_v: np.ndarray, at_w: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Of words after others, and of words alone, toxic and ordinary; by their places, -1 for a word that neither class has. The
        shared factor of such a word, which cancels out, is left out."""
        both = np.flatnonzero((at_v >= 0) & (at_w >= 0))
        key = _find(self.keys, at_v[both] * len(self.words) + at_w[both])
        both, key = both[key >= 0], key[key >= 0]
        after, alone = [], []
        for own, left, below, unseen in zip(self.own, self.left, self.below, self.unseen, strict=True):
            # The last entry of each is taken for -1.
            alone.append(np.append(below, unseen)[at_w])
            after.append(np.append(left, 1.0)[at_v] * alone[-1])
            after[-1][both] += own[key]
        return after, alone

    def ratios(self, words: list[str], said: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood ratios of all words of texts, as ``sequences`` gives them: after others, and alone."""
        at_w = _find(self.words, _hashes(words))[said]
        at_v = np.r_[-1, at_w[:-1]] if len(at_w) else at_w
        at_v[bounds[:-1][np.diff(bounds) > 0]] = _find(self.words, _hashes([BEGIN]))[0]
        after, alone = (np.log(np.maximum(p, 1e-300)) for p in self.probabilities(at_v, at_w))
        return after[0] - after[1], alone[0] - alone[1]

    def features(self, texts) -> np.ndarray:
        words, said, bounds = sequences(texts)
        after, alone = self.ratios(words, said, bounds)
        return np.array([document_features(after[a:b], alone[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]).reshape(-1, FEATURES)


def document_features(after: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Mean ratio of words after others, of the top one, three and ten words alone, and length; zeros without words."""
    if not len(after):
        return np.zeros(FEATURES)
    top = -np.sort(-np.partition(alone, max(0, len(alone) - 10))[-10:])
    return np.array([after.mean(), top[0], top[:3].sum() / 3, top.sum() / 10, np.log1p(len(after))])


class Classifier:
    """The models, with the weights that turn a document's features into a probability."""

    def __init__(self, model: KneserNey):
        self.model = model
        self.weights = np.zeros(FEATURES + 1)
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1], -30, 30)))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression by Newton's method; without both classes the score is 0 for all."""
        if not len(y) or y.min() == y.max():
            self.weights[-1] = -30
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        w = np.zeros(z.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            gradient = z.T @ (p - y) + 0.1 * np.r_[w[:-1], 0]
            w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(len(w)), gradient)
        self.weights = w


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int, chars: int) -> DataFrame:
    """(doc_id, text, label, fold) of the first labelled rows by the hash of their id: at most ``sample`` a class, which have at most
    ``chars`` characters in all, and none over an eighth of that. One row of those that repeat a doc_id, the least text."""
    labels = labels.where("label is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("label") > 0).cast("int").alias("label"))
    chosen = [labels.where(f"label = {k}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    chosen = spill(chosen[0].union(chosen[1]))  # two numbers for each row of the sample
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.where(F.length("text") <= chars // 8)
    one = Window.partitionBy("doc_id").orderBy("text")
    rows = spill(rows.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n"))
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    sized = rows.select("doc_id", "label", F.length("text").alias("n")).withColumn("n", F.sum("n").over(order)).where(F.col("n") <= chars)
    folds = sized.select("doc_id", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))
    return rows.join(F.broadcast(folds), "doc_id")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Classifier:
    """Count words of all documents, and bigrams of the labelled sample, whose bounds are ``sample`` rows and ``chars`` characters of
    each class. ``labels`` has doc_id and label; null labels don't count."""
    rows = spill(labelled_sample(docs, labels, sample, chars))
    vocabulary = docs.select("text").mapInPandas(_vocabulary, schema(word=STR, hash=LONG, documents=LONG))
    vocabulary = spill(vocabulary.groupBy("word").agg(F.any_value("hash").alias("hash"), F.sum("documents").alias("documents")))
    grams = spill(rows.select("text", "label", "fold").mapInPandas(_bigrams, schema(v=LONG, w=LONG, label=INT, fold=INT, n=LONG)).groupBy("v", "w", "label", "fold").agg(F.sum("n").alias("n")))
    total = vocabulary.agg(F.sum("documents")).first()[0] or 0
    # What reaches the driver is of the bounded sample: a bigram has two characters or more.
    shared = vocabulary.join(grams.select(F.col("w").alias("hash")).distinct(), "hash", "left_semi").groupBy("hash").agg(F.sum("documents").alias("documents")).toPandas().sort_values("hash")
    counted = grams.toPandas()

    def model(without: int | None) -> KneserNey:
        part = counted[counted.fold != without] if without is not None else counted
        each = part.assign(toxic=part.n * part.label, ordinary=part.n * (1 - part.label)).groupby(["v", "w"], as_index=False)[["toxic", "ordinary"]].sum()
        return KneserNey(each.v.to_numpy(), each.w.to_numpy(), [each.toxic.to_numpy(), each.ordinary.to_numpy()], shared["hash"].to_numpy(), shared.documents.to_numpy(), total)

    out = Classifier(model(None))
    folds = docs.sparkSession.sparkContext.broadcast([model(k) for k in range(FOLDS)])

    def calibration(it):
        for pdf in by_length(it):
            for k, part in pdf.groupby("fold"):
                yield pd.DataFrame(folds.value[k].features(part.text), columns=_NAMES).assign(label=part.label.to_numpy())

    got = rows.mapInPandas(calibration, schema(**dict.fromkeys(_NAMES, DBL), label=INT)).toPandas().sort_values([*_NAMES, "label"])
    out.calibrate(got[_NAMES].to_numpy(), got.label.to_numpy(float))
    folds.destroy()
    return out


_NAMES = [f"x{k}" for k in range(FEATURES)]


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id and score of every row. Takes doc_id and text; other columns are ignored, whatever their names. Null, empty and
    wordless texts are scored too, by features of zero; repeated rows get equal scores. An empty table gives an empty one."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # tables of the bounded sample

    def task(it):
        for pdf in by_length(it):
            yield pd.DataFrame({"doc_id": pdf.doc_id, "score": held.value.score(held.value.model.features(pdf.text))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(task, schema(doc_id=LONG, score=DBL))


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(3) != 1).select("doc_id", F.col("toxic").alias("label"))
    return score(docs, train(docs, labels)).select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
