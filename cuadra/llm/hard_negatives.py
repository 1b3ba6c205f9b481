"""Hard-negative mining: per anchor, all rows sorted by integer score, searched for each positive's upper limit.

Anchors meet all rows in cells of at most some thousand rows and anchors each. A cell sorts its rows by score and id for every anchor
of it; what it finds first is merged over the cells of an anchor, which is exact, since the first of all are among the first of each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import spill, table

#: Rows of a cell, and anchors of a cell, about; anchors whose scores are sorted at once.
BLOCK, STEP = 4096, 64
#: Scores up to here are exact as doubles.
EXACT = 1 << 53
POSITIVES = "me long, anchor_id long, id long, score long"
NEGATIVES = "me long, anchor_id long, place int, positive_id long, positive_score long, id long, score long"


def quantized(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as a 32-bit integer; null for a null vector or one with a null or non-finite component."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(sound, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int")))


def mine(vectors: DataFrame, is_anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """For each anchor and each of its first ``positives`` other rows of the same label, the first ``negatives`` rows of other labels
    whose score is from ``low`` to ``high`` percent of the positive's. Columns anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.

    Rows go by score, higher first, then by smaller id; null ids come last. Rows with a null label or an unsound vector take no part.
    Each row counts, so rows that repeat an id are found apart, and each of them is an anchor of its own. Vectors of different lengths
    don't meet. Components that exceed 32 bits, and scores that could exceed 2^53, are errors. An empty table gives no rows.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), quantized(F.col(vector), scale).alias("q"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    # Row numbers are written with the rows, so a task that runs again finds the same ones.
    rows = spill(rows.where(F.col("label").isNotNull() & F.col("q").isNotNull()).withColumn("rid", F.monotonically_increasing_id()))
    n = rows.agg(F.count("*").alias("rows"), F.count_if("anchor").alias("anchors")).first()
    down, across = (max(1, -(-n[k] // BLOCK)) for k in ("rows", "anchors"))
    deal = lambda rid, of: F.pmod(F.xxhash64(rid), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    keys = ["dim", "down", "across"]
    blocks = rows.select("rid", "id", "label", "q", F.size("q").alias("dim"), deal("rid", down).alias("down"), every(across).alias("across"))
    anchors = rows.where("anchor").select(F.col("rid").alias("me"), F.col("id").alias("anchor_id"), F.col("label").alias("own"), F.col("q").alias("v"), F.size("q").alias("dim"))

    def meet(anchors: DataFrame, cell, schema: str) -> DataFrame:
        dealt = anchors.withColumns({"across": deal("me", across), "down": every(down)})
        return blocks.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(cell, schema)

    def first(found: DataFrame, by: list[str], most: int, name: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"))
        return found.withColumn(name, F.row_number().over(order)).where(F.col(name) <= most)

    near = first(meet(anchors, _positives(positives), POSITIVES), ["me"], positives, "place")
    wanted = near.groupBy("me").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("wanted"))  # ``positives`` at most
    found = first(meet(anchors.join(wanted, "me"), _negatives(negatives, low, high), NEGATIVES), ["me", "place"], negatives, "rank")
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _matrix(rows: pa.Table, vector: str) -> np.ndarray:
    values = rows[vector].combine_chunks().flatten().to_numpy()
    return values.reshape(len(rows), -1).astype(np.float64) if len(rows) else np.empty((0, 0))


def _sorted(rows: pa.Table, anchors: pa.Table):
    """The rows of a cell by id, and per step of anchors: where it begins, and its rows' order and scores, the highest first."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("id", "ascending")], null_placement="at_end"))
    a, r = _matrix(anchors, "v"), _matrix(rows, "q")
    if a.size and r.size and int(np.abs(a).max()) * int(np.abs(r).max()) * a.shape[1] >= EXACT:
        raise OverflowError("scores could exceed 2^53")

    def steps():
        for at in range(0, len(anchors) if len(rows) else 0, STEP):
            scores = (a[at : at + STEP] @ r.T).astype(np.int64)
            order = np.argsort(-scores, axis=1, kind="stable")  # ties stay in the order of ids
            yield at, order, np.take_along_axis(scores, order, 1)

    return rows, steps()


def _positives(most: int):
    def cell(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        rows, steps = _sorted(rows, anchors)
        labels, rids = rows["label"].to_numpy(), rows["rid"].to_numpy()
        own, me = anchors["own"].to_numpy(), anchors["me"].to_numpy()
        whose, which, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at, order, score in steps:
            hit = (labels[order] == own[at : at + len(order), None]) & (rids[order] != me[at : at + len(order), None])
            i, j = np.nonzero(hit & (np.cumsum(hit, 1) <= most))
            whose, which, scores = [*whose, at + i], [*which, order[i, j]], [*scores, score[i, j]]
        mine = anchors.take(np.concatenate(whose))
        return pa.table({"me": mine["me"], "anchor_id": mine["anchor_id"], "id": rows["id"].take(np.concatenate(which)), "score": np.concatenate(scores)})

    return cell


def _negatives(most: int, low: int, high: int):
    def cell(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        rows, steps = _sorted(rows, anchors)
        labels, own = rows["label"].to_numpy(), anchors["own"].to_numpy()
        lists = anchors["wanted"].combine_chunks()
        wanted, ends = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64).cumsum()
        limits = wanted.field("score").to_numpy(zero_copy_only=False).astype(np.int64)
        upper, lower = high * limits // 100, -(-low * limits // 100)
        whose, which, scores = [], [], []
        for at, order, score in steps:
            for k in range(len(order)):
                others = np.flatnonzero(labels[order[k]] != own[at + k])
                down = -score[k][others]
                for w in range(ends[at + k - 1] if at + k else 0, ends[at + k]):
                    first = np.searchsorted(down, -upper[w])
                    last = min(first + most, np.searchsorted(down, -lower[w], side="right"))
                    whose += [w] * (last - first)
                    which += order[k][others[first:last]].tolist()
                    scores += (-down[first:last]).tolist()
        w = np.array(whose, np.int64)
        mine, to = anchors.take(np.searchsorted(ends, w, side="right")), wanted.take(pa.array(w))
        return pa.table({
            "me": mine["me"], "anchor_id": mine["anchor_id"], "place": to.field("place"), "positive_id": to.field("id"), "positive_score": to.field("score"),
            "id": rows["id"].take(pa.array(which, pa.int64())), "score": pa.array(scores, pa.int64()),
        })

    return cell


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th row of ``embeddings``, every seventh row under another label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.q, r.q) AS BIGINT) AS score FROM e a JOIN e r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 3"""
