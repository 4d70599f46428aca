"""Hard negatives by vantage-point trees over norm-augmented vectors.

With one more component, sqrt(M^2 - |x|^2), all vectors of a block lie on a sphere of radius M and an anchor's inner
product with one is a distance: d^2 = |anchor|^2 + M^2 - 2 score. A window of scores is an annulus of distances. Each
block of rows has a tree of vantage points; leaves outside the annulus are never looked at, the others are traversed
nearest first, a few more at a time, until k rows with the wanted label are nearer than all that is left.

Scores are exact integers; distances only prune, with slack for rounding. Every row is indexed. Rows are dealt to blocks of a
bounded size, and anchors, a stated query set, pass through every block's tree in batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm import base

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 10, 30, 90
#: Bytes of a block's vectors, as 8-byte numbers, and rows of a leaf.
BLOCK_BYTES, LEAF = 64 << 20, 128
#: Slack of distances, as a share of the radii.
SLACK = 1e-6


def quantised(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): doubles where they hold it exactly, else Python's integers."""
    with np.errstate(over="ignore"):
        out = np.floor(vectors.astype(np.float64) * scale)
    if not out.size or np.abs(out).max() < 2.0**52:
        return out
    return np.array([[math.floor(v * scale) if abs(v) < 2.0**52 else int(v) * scale for v in row] for row in vectors.tolist()], object).reshape(vectors.shape)


class VantagePointTree:
    """Rows of one length: ids, labels, vectors [n, d] of whole numbers."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        place, x, label = np.arange(len(ids)), vectors[order], labels[order]
        self.norms = (x.astype(np.float64) ** 2).sum(1)
        self.radius2 = float(self.norms.max())
        extra = np.sqrt(np.maximum(self.radius2 - self.norms, 0))
        near = np.concatenate([x.astype(np.float64), extra[:, None]], 1)
        #: Nodes in order of depth: vantage point, children; a leaf has a range of rows. Ranges of distances by child.
        self.leaves, points, self.steps = [], [], []
        work = [(np.arange(len(ids)), -1, 0, 0.0, math.inf)]
        while work:
            rows, parent, depth, least, most = work.pop()
            if len(rows) <= LEAF or not len(near):
                self.leaves.append(rows)
                self.steps.append((parent, depth, least, most, -1, len(self.leaves) - 1))
                continue
            centre = near[rows].mean(0)
            point = rows[((near[rows] - centre) ** 2).sum(1).argmax()]  # far from the middle, so distances differ
            away = np.sqrt(np.maximum(2 * self.radius2 - 2 * (near[rows] @ near[point]), 0))
            half = np.argpartition(away, len(rows) // 2)
            points.append(point)
            self.steps.append((parent, depth, least, most, len(points) - 1, -1))
            own = len(self.steps) - 1
            for side in (half[: len(rows) // 2], half[len(rows) // 2 :]):
                work.append((rows[side], own, depth + 1, float(away[side].min()), float(away[side].max())))
        self.points = x[points]
        at = np.concatenate(self.leaves)
        self.ends = np.cumsum([0] + [len(r) for r in self.leaves])
        self.x, self.rank, self.label = x[at], place[at], label[at]
        self.most = float(np.sqrt(self.radius2))

    def bounds(self, anchors: np.ndarray, norm2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest distance of each anchor to each leaf's rows."""
        slack = SLACK * (np.sqrt(norm2) + self.most) + 1e-9
        away = np.sqrt(np.maximum(norm2[:, None] + self.radius2 - 2 * (anchors @ self.points.T).astype(np.float64), 0)) if len(self.points) else None
        low, high = [None] * len(self.steps), [None] * len(self.steps)
        near, far = np.zeros((len(anchors), len(self.leaves))), np.zeros((len(anchors), len(self.leaves)))
        for i, (parent, _, least, most, _, leaf) in enumerate(self.steps):
            if parent < 0:
                low[i], high[i] = np.zeros(len(anchors)), np.full(len(anchors), math.inf)
            else:
                d = away[:, self.steps[parent][4]]
                low[i] = np.maximum(low[parent], np.maximum(d - most, least - d) - slack)
                high[i] = np.minimum(high[parent], d + most + slack)
            if leaf >= 0:
                near[:, leaf], far[:, leaf] = low[i], high[i]
        return near, far

    def search(self, anchors: np.ndarray, ids: np.ndarray, labels: np.ndarray, lows: np.ndarray, highs: np.ndarray, same: bool, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each anchor and window (lows, highs: whole numbers [n, w], highs None without bound) its k best rows with
        the same label, or with another: (anchor, window, id, score) as arrays. Rows with the anchor's id are left out."""
        m, w = lows.shape
        norm2 = (anchors.astype(np.float64) ** 2).sum(1)
        scale = 1 << len(self.ids).bit_length()
        top = math.sqrt(norm2.max()) * self.most + 1
        exact = anchors.dtype != object and self.x.dtype != object and top < 2.0**53 and top * scale < 2.0**61
        cast = (lambda v: v) if exact else lambda v: np.vectorize(int, otypes=[object])(v) if v.size else v.astype(object)
        anchors, points, x = cast(anchors), cast(self.points), cast(self.x)
        kind, none = (np.int64, -(1 << 62)) if exact else (object, -(1 << 20000))
        # Windows beyond what any score reaches end there, so that they fit.
        low, high = (np.array([[min(max(int(v), -math.ceil(top)), math.ceil(top)) for v in row] for row in s], kind).reshape(m, w) for s in (lows, highs))
        shut = np.array([[a > b for a, b in zip(r, s)] for r, s in zip(lows, highs)], bool).reshape(m, w)
        slack = SLACK * (np.sqrt(norm2) + self.most)[:, None] + 1e-9
        inner, outer = (np.sqrt(np.maximum(norm2[:, None] + self.radius2 - 2 * v.astype(np.float64), 0)) + s for v, s in ((high, -slack), (low, slack)))
        near, far = self.bounds(anchors if exact else anchors.astype(np.float64), norm2)
        order = np.argsort(near, axis=1, kind="stable")
        within = ((near[:, :, None] <= outer[:, None]) & (far[:, :, None] >= inner[:, None]) & ~shut[:, None]).any(2)
        best = np.full((m, w, k), none, kind)
        done, step = 0, 1
        while done < len(self.leaves):
            # Nearest first: windows whose k rows are nearer than all leaves left are complete.
            worst = best.min(2)
            full = worst != none
            reach = np.where(full & exact, np.sqrt(np.maximum(norm2[:, None] + self.radius2 - 2 * (np.where(full & exact, worst, 0) // scale).astype(np.float64), 0)) + slack, outer)
            live = (np.minimum(reach, outer) >= np.take_along_axis(near, order[:, done : done + 1], 1)) & ~shut
            if not live.any():
                break
            some = order[:, done : done + step]
            visit = np.zeros(near.shape, bool)
            np.put_along_axis(visit, some, True, 1)
            visit &= within & live.any(1)[:, None]
            for leaf in np.flatnonzero(visit.any(0)):
                who = np.flatnonzero(visit[:, leaf])
                a, e = self.ends[leaf], self.ends[leaf + 1]
                scores = anchors[who] @ x[a:e].T
                scores = scores.astype(np.int64) if exact else np.minimum(np.maximum(scores, -(1 << 63)), (1 << 63) - 1)
                fits = ((labels[who, None] == self.label[None, a:e]) == same) & (ids[who, None] != self.ids[self.rank[a:e]][None])
                keys = np.where(fits, scores * scale + (scale - 1 - self.rank[a:e])[None], none)
                for j in range(w):
                    inside = np.where((scores >= low[who, j, None]) & (scores <= high[who, j, None]), keys, none)
                    more = np.flatnonzero((inside.max(1) > worst[who, j]) & ~shut[who, j])
                    if len(more):
                        both = np.concatenate([best[who[more], j], inside[more]], 1)
                        best[who[more], j] = np.sort(both, axis=1)[:, -k:] if kind is object else np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                worst = best.min(2)
            done, step = done + step, 2 * step
        i, j, n = np.nonzero(best != none)
        found = best[i, j, n]
        yield i, j, self.ids[(scale - 1 - found % scale).astype(np.int64)], found // scale


def dealt(rows: DataFrame, anchors: DataFrame, blocks: int) -> DataFrame:
    """Rows in their blocks (kind 0), each followed by all anchors (kind 1)."""
    spread = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("kind", F.lit(1))
    mine = rows.withColumn("block", F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)).cast("int")).withColumn("kind", F.lit(0))
    every = mine.unionByName(spread, allowMissingColumns=True).select("block", "kind", "id", "label", "vector", "anchor", "positives", "scores")
    return every.repartitionById(blocks, "block").sortWithinPartitions("block", "kind")


def searched(rows: DataFrame, anchors: DataFrame, blocks: int, k: int, scale: int, window: tuple[int, int] | None) -> DataFrame:
    """anchor, anchor_id, positive (its number), positive_id, positive_score, id, score: the k best rows of each block
    for each anchor. Without window: those with the anchor's label (positive is 0). With one, in per cent: those with another label, for each of the anchor's
    positives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, trees = None, [], None

        def planted() -> dict[int, VantagePointTree]:
            by_size: dict[int, list] = {}
            for ids, labels, vectors in held:
                sizes = vectors.value_lengths().to_numpy()
                flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
                for n in np.unique(sizes):
                    some = np.flatnonzero(sizes == n)
                    by_size.setdefault(int(n), []).append((ids[some], labels[some], quantised(flat[(ends[some] - n)[:, None] + np.arange(n)], scale)))
            return {n: VantagePointTree(*(np.concatenate([x[i] for x in many]) for i in range(3))) for n, many in by_size.items()}

        def asked(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            ids, labels, vectors, names = (batch.column(c).to_numpy() if c != "vector" else batch.column(c) for c in ("id", "label", "vector", "anchor"))
            sizes = vectors.value_lengths().to_numpy()
            for n in np.unique(sizes):
                if int(n) not in trees:
                    continue
                some = np.flatnonzero(sizes == n)
                own = batch.take(pa.array(some))
                x = quantised(own.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(some), n), scale)
                scores, others = own.column("scores").to_pylist(), own.column("positives").to_pylist()
                if window is None:
                    lows, highs = [[-(10**400)]] * len(some), [[10**400]] * len(some)
                else:
                    wide = max(map(len, scores), default=0)
                    lows = [[-((-window[0] * s) // 100) for s in row] + [1] * (wide - len(row)) for row in scores]
                    highs = [[window[1] * s // 100 for s in row] + [0] * (wide - len(row)) for row in scores]
                lows, highs = (np.array(v, object).reshape(len(some), -1) for v in (lows, highs))
                if not lows.shape[1]:
                    continue
                for i, j, found, score in trees[int(n)].search(x, ids[some], labels[some], lows, highs, window is None, k):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(names[some][i]), pa.array(ids[some][i]), pa.array(j.astype(np.int32)), pa.array([others[a][b] if window else None for a, b in zip(i, j)], pa.int64()),
                        pa.array([scores[a][b] if window else None for a, b in zip(i, j)], pa.int64()), pa.array(found), pa.array(score.tolist(), pa.int64()),
                    ], names=["anchor", "anchor_id", "positive", "positive_id", "positive_score", "id", "score"])

        for batch in batches:
            block, kind = (batch.column(i).to_numpy() for i in (0, 1))
            edges = np.flatnonzero(np.diff(block) | np.diff(kind)) + 1
            for a, e in zip([0, *edges], [*edges, len(block)], strict=True):
                if e == a:
                    continue
                if block[a] != at:
                    at, held, trees = block[a], [], None
                part = batch.slice(a, e - a)
                if kind[a] == 0:
                    held.append((part.column("id").to_numpy(), part.column("label").to_numpy(), part.column("vector")))
                else:
                    if trees is None:
                        trees, held = planted(), []
                    yield from asked(part)

    return dealt(rows, anchors, blocks).mapInArrow(run, "anchor long, anchor_id long, positive int, positive_id long, positive_score long, id long, score long")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor and positive over all blocks, with their rank."""
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """rows: id (long), label (long), vector (array of float or double). Returns anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.

    Components become floor(scale * x); a score is their inner product. Higher scores come first, ties by smaller id. An
    anchor's positives are its first rows with the same label, its own id left out; for each of them, the first
    negatives rows with another label whose score is between low and high per cent of the positive's. Rows without id,
    label or vector, or with a null or non-finite component, take no part. Vectors of different lengths have no score.
    Repeated rows are rows each, but a repeated anchor is one anchor. A score beyond 64 bits counts as the nearest one
    within. An empty table gives no rows."""
    spark = rows.sparkSession
    folder = base.scratch(spark) + "/negatives"
    kind = "array<float>" if rows.schema["vector"].dataType.simpleString() == "array<float>" else "array<double>"
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    live = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vector").cast(kind).alias("vector"), is_anchor.alias("asked")).where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    size = live.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()[0]
    blocks = max(base.partitions(spark), -(-8 * size // block_bytes))
    every = live.select("id", "label", "vector")
    anchors = live.where("asked").select("id", "label", "vector").distinct().withColumn("anchor", F.monotonically_increasing_id())
    anchors = base.written(anchors.withColumn("positives", F.lit(None).cast("array<long>")).withColumn("scores", F.lit(None).cast("array<long>")), f"{folder}/anchors")
    first = best_of(searched(every, anchors, blocks, positives, scale, None), positives)
    listed = first.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))
    known = base.written(listed.select("anchor", F.transform("p", lambda x: x["id"]).alias("positives"), F.transform("p", lambda x: x["score"]).alias("scores")), f"{folder}/positives")
    found = best_of(searched(every, anchors.drop("positives", "scores").join(known, "anchor"), blocks, negatives, scale, (low, high)), negatives)
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine(rows.select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector")), F.col("id") % 100 == 0)


def oracle() -> str:
    return f"""with r as (select vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end label, list_transform(embedding, lambda x: floor({SCALE} * x::double)) v
from embeddings where label is not null and embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id a, r.vec_id, a.label = r.label same, list_inner_product(a.v, r.v)::bigint score from r a join r on a.vec_id <> r.vec_id where a.vec_id % 100 = 0),
p as (select a, vec_id positive_id, score positive_score from s where same qualify row_number() over (partition by a order by score desc, vec_id) <= {POSITIVES}),
n as (select p.a, positive_id, positive_score, s.vec_id negative_id, s.score negative_score, row_number() over (partition by p.a, positive_id order by s.score desc, s.vec_id) rank
from p join s on p.a = s.a and not same and {LOW} * positive_score <= 100 * s.score and 100 * s.score <= {HIGH} * positive_score)
select a as anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= {NEGATIVES}"""
