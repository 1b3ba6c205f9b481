"""MinHash near-dedup with odd sketches.

Rows with equal shingle sets form a class. Classes that share a band of MinHash samples are candidates. XOR population counts of
odd sketches, parity bitmaps of the samples, estimate similarities, and promising pairs are confirmed on full sets, in two steps:

1. Each class meets the hub of each of its bands, the least class there. A group of near copies is joined by these links alone.
2. A band whose other classes aren't all connected by then is looked at again: blocks of it meet by their sketches; classes with a
   promising partner in another component fetch their sets, and a spanning forest of true links leaves each pair of blocks. A pair
   meets in the first band that it shares only; later bands pass it over.

So the work on a group of near copies grows with its size, and what is compared in pairs are only sketches of classes that share
a band, are of like size and aren't connected. Classes that are alike but not linked have to be compared in pairs; that is done
within blocks, which are larger where sets are small, so that rows aren't repeated for every few classes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BIN, INT, LONG, MinHash, connected, mix, partitions, schema, shingle_set, signed, sorted_groups, spill

#: A pair at the 85 % threshold shares no band with a probability of (1 - 0.85 ** 6) ** 32, about 3 in 10 million.
BANDS, ROWS = 32, 6
SKETCH_BITS = 512
PERCENT = 85
#: At 80 %, the general rule, (1 - 0.8 ** 5) ** 40 is about 1 in 10 million; 32 x 6 would miss 6 pairs in 100,000.
GENERAL_PERCENT, GENERAL_BANDS, GENERAL_ROWS = 80, 40, 5
#: Estimates below the threshold by more than this, over five standard deviations, aren't confirmed; they spread more at 80 %.
MARGIN, GENERAL_MARGIN = 0.15, 0.18
#: Classes in a block of a band, and classes that meet a hub in one task.
BLOCK, STAR = 128, 256
#: Blocks have up to this many times as many classes, as long as the sets of one have no more shingles than that, of 8 bytes each.
WIDE, SHINGLES = 4, 1_000_000
#: Classes, of 48 bytes each, that are broadcast to fetch their texts, 48 MB at most; more of them are joined by a shuffle.
FEW = 1_000_000


def banding(percent: int) -> tuple[int, int]:
    """Bands and rows by which a pair at the threshold shares a band but for about 1 in 10 million."""
    if percent >= PERCENT:
        return BANDS, ROWS
    if percent >= GENERAL_PERCENT:
        return GENERAL_BANDS, GENERAL_ROWS
    rows = 4 if percent >= 60 else 3 if percent >= 40 else 2 if percent >= 20 else 1
    return math.ceil(math.log(1e-7) / math.log1p(-((max(percent, 1) / 100) ** rows))), rows


def odd_sketch(samples: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    """Fold (place, sample) pairs into a parity bitmap."""
    place = np.arange(len(samples), dtype=np.uint64) << np.uint64(32)
    at = mix(place | samples.astype(np.uint64)) % np.uint64(bits)
    odd = np.bincount(at.astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def sketch_similarity(differing: np.ndarray, k: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """Jaccard estimates from XOR population counts of sketches of ``k`` samples."""
    share = np.minimum(1 - 2 * differing / bits, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = np.log(np.maximum(share, 1e-9)) / math.log(1 - 2 / bits)
    return 1 - apart / (2 * k)


def band_hashes(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    x = samples.reshape(bands, rows).astype(np.uint64)
    h = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + x[:, j])
    return signed(h)


def _sign(n: int, bands: int, rows: int):
    def task(it):
        hashes = MinHash(bands * rows)
        for pdf in it:
            out = []
            for d, th, x in zip(pdf.doc_id, pdf.th, pdf.text, strict=True):
                s = shingle_set(x, n)
                if len(s):
                    samples = hashes.samples(s)
                    out.append((d, th, len(s), xxhash.xxh3_128_digest(s.tobytes()), band_hashes(samples, bands, rows), odd_sketch(samples)))
                else:
                    out.append((d, th, 0, None, None, None))
            yield pd.DataFrame(out, columns=["doc_id", "th", "n_shingles", "key", "bands", "sketch"]).astype({"doc_id": "Int64"})

    return task


def _sets(n: int):
    """Full sets of classes; rows whose text isn't of the class, though its hash is, go, and so do repeated ones of a batch."""

    def task(it):
        for pdf in it:
            rows = []
            for node, key, x in pdf.drop_duplicates("node")[["node", "key", "text"]].itertuples(index=False):
                members = shingle_set(x, n).tobytes()
                if xxhash.xxh3_128_digest(members) == key:
                    rows.append((node, members))
            yield pd.DataFrame(rows, columns=["node", "members"])

    return task


def _bits(sketches) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint64).reshape(-1, SKETCH_BITS // 64)


def _margin(percent: int) -> float:
    return MARGIN if percent >= PERCENT else GENERAL_MARGIN if percent >= GENERAL_PERCENT else 1


def promising(a: np.ndarray, b: np.ndarray, size_a, size_b, percent: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether pairs may be links, by their sketches and sizes; and how many bits of their sketches differ."""
    differing = np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)
    near = sketch_similarity(differing, k) >= percent / 100 - _margin(percent)
    return near & (100 * np.minimum(size_a, size_b) >= percent * np.maximum(size_a, size_b)), differing


def is_link(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _likely(percent: int, k: int):
    def task(it):
        for pdf in it:
            near, _ = promising(_bits(pdf.sa), _bits(pdf.sb), pdf.na.to_numpy(), pdf.nb.to_numpy(), percent, k)
            yield pdf.loc[near, ["a", "b"]]

    return task


def _star(percent: int):
    """Rows of a hub, its own first, to its links. Only the hub's set is held."""

    def task(it):
        hub, own = None, None
        for pdf in it:
            out = []
            for b, side, node, members in zip(pdf.b, pdf.side, pdf.node, pdf.members, strict=True):
                x = np.frombuffer(members, np.uint64)
                if side == 0:
                    hub, own = b, x
                elif hub == b and is_link(own, x, percent):
                    out.append((b, node))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return task


def _pairs_of_blocks(pdf: pd.DataFrame, percent: int, k: int) -> np.ndarray:
    """Rows (place, place, differing bits) of the promising pairs of a pair of blocks that aren't in one component, and share none of
    the bands before this one where the rows bear them (``bands``, and ``at``, the number of those before)."""
    sketch, size, label, side = _bits(pdf.sketch), pdf.n.to_numpy(), pdf.label.to_numpy(), pdf.side.to_numpy()
    before = np.stack(pdf.bands.to_numpy())[:, : pdf["at"].iloc[0]] if "bands" in pdf and len(pdf) else None
    one = not side.any()
    left = np.flatnonzero(side == 0)
    right = left if one else np.flatnonzero(side == 1)
    found = [np.empty((0, 3), np.int64)]
    for a in left:
        b = right[right > a] if one else right
        b = b[label[b] != label[a]]
        near, differing = promising(sketch[a], sketch[b], size[a], size[b], percent, k)
        if before is not None:
            near[near] = ~(before[a] == before[b[near]]).any(1)
        found.append(np.stack([np.full(near.sum(), a), b[near], differing[near]], 1))
    return np.concatenate(found)


def _survivors(percent: int, k: int):
    def task(it):
        for group in sorted_groups(it, GROUP):
            group = group.reset_index(drop=True)
            pairs = _pairs_of_blocks(group, percent, k)
            if len(pairs):
                yield group.iloc[np.unique(pairs[:, :2])]

    return task


def confirm(pdf: pd.DataFrame, percent: int, k: int) -> list[tuple[int, int]]:
    """A spanning forest of the true links between components, between the classes of side 0 and of side 1, or among all where
    there is one block; as pairs of labels."""
    sets = [np.frombuffer(x, np.uint64) for x in pdf.members]
    pairs = _pairs_of_blocks(pdf, percent, k)
    pairs = pairs[np.argsort(pairs[:, 2], kind="stable")]
    labels = pdf.label.tolist()
    root = {x: x for x in labels}

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for a, b in pairs[:, :2].tolist():
        p, q = top(labels[a]), top(labels[b])
        if p != q and is_link(sets[a], sets[b], percent):
            root[p] = q
            links.append((labels[a], labels[b]))
    return links


def _confirmed(percent: int, k: int):
    def task(it):
        for group in sorted_groups(it, GROUP):
            found = confirm(group.drop_duplicates(["side", "node"], ignore_index=True), percent, k)
            if found:
                yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return task


#: What tells apart pairs of blocks: a band, and the size class and number of either block.
GROUP = ["band", "c", "i", "d", "j"]
_BLOCKS = schema(band=LONG, c=INT, i=INT, d=INT, j=INT, side=INT, node=LONG, label=LONG, n=LONG, sketch=BIN, at=INT, bands=T.ArrayType(LONG))


def _blocks(rows: DataFrame, percent: int, block: int) -> DataFrame:
    """Rows (band, node, label, n, sketch, at, bands) once for each pair of blocks that they are in: those of one size class, or of two that
    follow each other, since links have like sizes. Bands of one block aren't classed by size."""
    sizes = rows.groupBy("band").agg(F.count("*").alias("m"), F.greatest(F.lit(block), F.least(F.lit(WIDE * block), F.floor(F.lit(SHINGLES) / F.max("n")))).alias("least"))
    step = max(1e-7, -1.0001 * math.log(max(percent, 1) / 100))
    per = F.greatest("least", F.ceil(2 * F.sqrt("m")))
    rows = rows.join(sizes, "band").withColumn("c", F.when(F.col("m") <= F.col("least"), 0).otherwise(F.floor(F.log(F.col("n").cast("double")) / step)).cast("int"))
    classes = spill(rows.groupBy("band", "c", "m", "least").agg(F.count("*").alias("own")).withColumn("blocks", F.ceil(F.col("own") / per).cast("int")).select("band", "c", "blocks"))
    near = lambda d, name: classes.select("band", (F.col("c") + d).alias("c"), F.col("blocks").alias(name))
    rows = rows.join(classes, ["band", "c"]).join(near(-1, "above"), ["band", "c"], "left").join(near(1, "below"), ["band", "c"], "left")
    own = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    upto = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    to = lambda c, i, d, j, side: F.struct(c.alias("c"), i.alias("i"), d.alias("d"), j.alias("j"), side.cast("int").alias("side"))
    c = F.col("c")
    where = F.concat(
        F.transform(upto(F.col("blocks")), lambda o: to(c, F.least(o, own), c, F.greatest(o, own), own > o)),
        F.transform(upto(F.col("above")), lambda o: to(c, own, c + 1, o, F.lit(0))),
        F.transform(upto(F.col("below")), lambda o: to(c - 1, o, c, own, F.lit(1))),
    )
    kept = ["node", "label", "n", "sketch", "at", "bands"]
    return rows.select("band", F.explode(where).alias("to"), *kept).select("band", "to.*", *kept)


def classes_of(docs: DataFrame, shingle: int, percent: int, bands: int | None, rows: int | None, block: int, tied: bool) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` (doc_id, th, n_shingles, key), th the hash of the text, and classes (key, first), first the least doc_id
    and th in the component of a class. ``tied`` links the classes of all texts of a doc_id."""
    if bands is None or rows is None:
        bands, rows = banding(percent)
    k, shards = bands * rows, partitions(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    signed_docs = spill(docs.mapInPandas(_sign(shingle, bands, rows), schema(doc_id=LONG, th=LONG, n_shingles=LONG, key=BIN, bands=T.ArrayType(LONG), sketch=BIN)))
    with_words = signed_docs.where("key is not null and doc_id is not null")
    # Equal sets have equal bands and sketches. Written, so that the numbers of classes stay, and later joins can split a large class.
    heads = with_words.groupBy("key").agg(F.min(F.struct("doc_id", "th")).alias("first"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))
    heads = spill(heads.withColumn("node", F.monotonically_increasing_id()))
    sketches = heads.select("node", "n", "sketch")

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = spill(heads.join(nodes, "node", "left_semi").select("node", "key", F.col("first.doc_id").alias("doc_id"), F.col("first.th").alias("th")))
        wanted = F.broadcast(wanted) if wanted.count() <= FEW else wanted
        return spill(docs.join(wanted, ["doc_id", "th"]).select("node", "key", "text").mapInPandas(_sets(shingle), schema(node=LONG, members=BIN)))

    banded = heads.select("node", F.posexplode("bands").alias("at", "band"))
    hubs = banded.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last").select("band", "hub")
    members = spill(banded.join(hubs, "band").where("node <> hub"))

    # Each class and the hubs of its bands.
    pairs = members.select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    pairs = pairs.join(sketches.toDF("a", "na", "sa"), "a").join(sketches.toDF("b", "nb", "sb"), "b")
    likely = spill(pairs.select("a", "b", "na", "sa", "nb", "sb").mapInPandas(_likely(percent, k), schema(a=LONG, b=LONG)))
    sets = sets_of(likely.select("a").union(likely.select("b")).withColumnRenamed("a", "node"))
    parts = spill(likely.groupBy("b").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts")))
    of_hubs = parts.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), F.col("b").alias("node"))
    others = likely.join(parts, "b").select("b", F.pmod(F.xxhash64("a"), "parts").cast("int").alias("part"), F.lit(1).alias("side"), F.col("a").alias("node"))
    meet = of_hubs.union(others).join(sets, "node").repartition(shards, "b", "part").sortWithinPartitions("b", "part", "side")
    links = meet.select("b", "side", "node", "members").mapInPandas(_star(percent), schema(a=LONG, b=LONG))
    if tied:
        of_ids = with_words.join(heads.select("key", "node"), "key").select("doc_id", "node").distinct()
        several = of_ids.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("doc_id", "a")
        links = links.union(of_ids.join(several, "doc_id").select("a", F.col("node").alias("b")))
    components = connected(links)
    named = spill(heads.select("node").join(components.withColumnRenamed("id", "node"), "node", "left").select("node", F.coalesce("label", "node").alias("label")))

    # Bands whose other classes aren't connected; the first of those with the same classes, since pairs meet in the first they share.
    labelled = members.join(named, "node").select("band", "at", "node", "label")
    about = labelled.groupBy("band").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("m"), F.min("at").alias("at"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    open_ = about.where("least <> most").groupBy("least", "most", "m", "x", "y").agg(F.min_by("band", F.struct("at", "band")).alias("band")).select("band")
    rest = spill(labelled.join(spill(open_), "band").join(heads.select("node", "n", "sketch", "bands"), "node").select("band", "node", "label", "n", "sketch", "at", "bands"))
    met = _blocks(rest, percent, block).repartition(shards, *GROUP).sortWithinPartitions(*GROUP)
    met = spill(met.select(_BLOCKS.names).mapInPandas(_survivors(percent, k), _BLOCKS))
    missing = met.select("node").distinct().join(sets, "node", "left_anti")
    full = met.join(sets.union(sets_of(missing)), "node").repartition(shards, *GROUP).sortWithinPartitions(*GROUP)
    more = full.select(*_BLOCKS.names, "members").mapInPandas(_confirmed(percent, k), schema(a=LONG, b=LONG))
    again = connected(more).toDF("label", "joined")
    named = named.join(again, "label", "left").select("node", F.coalesce("joined", "label").alias("label"))

    classes = heads.select("node", "key", "first").join(named, "node")
    firsts = spill(classes.groupBy("label").agg(F.min("first").alias("first")))
    return signed_docs.drop("bands", "sketch"), classes.select("key", "label").join(firsts, "label").select("key", "first")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = PERCENT, bands: int | None = None, rows: int | None = None, block: int = BLOCK) -> DataFrame:
    """Link documents whose shingle sets have a Jaccard similarity of ``percent`` / 100 or more, and label the components.

    Takes ``doc_id`` and ``text`` of ``docs``; other columns are ignored, whatever their names. Returns one row per input row:
    doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id is that one). Null, empty and wordless texts have
    no shingles and link with nothing. Rows that repeat a doc_id are one node with the links of all its texts; all of them bear
    its label. A row with a null doc_id links with nothing and isn't kept. An empty table gives an empty one. Bands and rows that
    aren't given suit ``percent``.
    """
    found, classes = classes_of(docs, shingle, percent, bands, rows, block, tied=True)
    # A row without words that repeats the doc_id of one with words bears that one's label.
    labelled = found.join(classes, "key", "left").select("doc_id", "n_shingles", F.col("first.doc_id").alias("own"))
    wordless = spill(found.where("key is null and doc_id is not null").select("doc_id").distinct())
    of_ids = found.where("key is not null").join(wordless, "doc_id", "left_semi").join(classes, "key").groupBy("doc_id").agg(F.min("first.doc_id").alias("other"))
    labelled = labelled.join(spill(of_ids), "doc_id", "left")
    component = F.coalesce("own", "other", "doc_id")
    return labelled.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = GENERAL_PERCENT) -> DataFrame:
    """``docs``, all columns, with one document of each group of near copies: the one of the smallest doc_id.

    Rows are judged by their own texts: different texts under one doc_id stay, unless they are near copies of each other, and one
    row stays of those that repeat doc_id and text. Texts without words, and rows without a doc_id, stay. An empty table gives an
    empty one.
    """
    found, classes = classes_of(docs, shingle, percent, None, None, BLOCK, tied=False)
    same = F.col("first").isNull() | (F.struct("doc_id", "th") == F.col("first"))
    kept = found.where("doc_id is not null").join(classes, "key", "left").where(same).select("doc_id", "th").distinct()
    # Columns of ``docs`` stay together, so that no name of theirs can clash.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"))
    once = Window.partitionBy("doc_id", "th").orderBy("row.text")
    named = rows.join(kept, ["doc_id", "th"], "left_semi").withColumn("n", F.row_number().over(once)).where("n = 1")
    return named.select("row.*").unionByName(docs.where("doc_id is null"))


def op2(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, gram FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' '))) AS gram FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (gram) WHERE a.doc_id < b.doc_id GROUP BY ALL
), links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (SELECT doc_id, doc_id AS z FROM d UNION SELECT reach.doc_id, b FROM reach JOIN ways ON a = z
), component AS (SELECT doc_id, min(z) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN component USING (doc_id)
"""


def brute_force(rows: list[tuple[int, str | None]], percent: int = PERCENT) -> list[tuple[int, int, int, bool]]:
    """The same by comparing all pairs, for tests. Rows that repeat a doc_id are one node."""
    sets = []
    for _, x in rows:
        w = (x or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * min(len(sets[i]), len(sets[j])) >= percent * max(len(sets[i]), len(sets[j])):
                shared = len(sets[i] & sets[j])
                if 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                    root[top(i)] = top(j)
    first: dict[int, int] = {}
    for k, (d, _) in enumerate(rows):
        root[top(k)] = top(first.setdefault(d, k))
    least: dict[int, int] = {}
    for k, (d, _) in enumerate(rows):
        least[top(k)] = min(d, least.get(top(k), d))
    return [(d, len(sets[k]), least[top(k)], d == least[top(k)]) for k, (d, _) in enumerate(rows)]
