"""Text encoder, and a scorer of triples with its training.

Features of a triple: sample_id, triple_id, x (array of float), made of the embeddings of question, head, relation and
tail, and the ends' topic marks and directional distances; free (two numbers): whether head and tail have no text of
their own, so that a learned vector, the same for all such entities, stands for their embedding."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import retrieval
from lattica.sources import records

Encoder = Callable[[list[str]], np.ndarray]


def hashed(texts: list[str], width: int = 64) -> np.ndarray:
    """Hashed three-letter groups of words, L2-normal: the encoder where no other one is given."""
    out = np.zeros((len(texts), width), np.float32)
    for i, text in enumerate(texts):
        padded = f" {text.lower()} "
        for j in range(max(1, len(padded) - 2)):
            h = zlib.crc32(padded[j : j + 3].encode())
            out[i, h % width] += 1 if h & 1 << 16 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embedded(texts: DataFrame, encode: Encoder = hashed) -> DataFrame:
    """texts: text. Each distinct text once, with its embedding; null ones go."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"text": frame["text"], "embedding": list(encode(frame["text"].tolist()))})

    return texts.select("text").where("text is not null").distinct().mapInPandas(run, "text string, embedding array<float>")


def features(triples: DataFrame, questions: DataFrame, nodes: DataFrame, embeddings: DataFrame) -> DataFrame:
    """questions: sample_id, question. nodes: sample_id, node and numbers, as graph.directional_distances gives them.
    Texts without an embedding (identifiers) get zeros, and heads and tails among them are free."""
    extra = [c for c in nodes.columns if c not in ("sample_id", "node")]
    width = F.lit(0.0).cast("float")
    e = embeddings.select("text", "embedding")
    out = triples.select("sample_id", "triple_id", "h", "r", "t").join(questions.select("sample_id", F.col("question").alias("q")), "sample_id")
    for c in "qhrt":
        out = out.join(e.select(F.col("text").alias(c), F.col("embedding").alias(f"e{c}")), c, "left")
    for c in "ht":
        out = out.join(nodes.select("sample_id", F.col("node").alias(c), F.array(*(F.col(x).cast("float") for x in extra)).alias(f"n{c}")), ["sample_id", c], "left")
    size = F.greatest(*(F.coalesce(F.size(f"e{c}"), F.lit(-1)) for c in "qhrt"))
    filled = [F.coalesce(F.col(f"e{c}"), F.array_repeat(width, size)) for c in "qhrt"] + [F.coalesce(F.col(f"n{c}"), F.array_repeat(width, F.lit(len(extra)))) for c in "ht"]
    free = F.array(*(F.col(f"e{c}").isNull().cast("int") for c in "ht"))
    return out.select("sample_id", "triple_id", F.concat(*filled).alias("x"), free.alias("free"))


class Network:
    """Linear, ReLU, linear; all weights in one vector. free: the length of an embedding, where a learned vector stands
    for heads and tails without one (the second and fourth part of x); 0 without such a vector."""

    def __init__(self, width: int, hidden: int, weights: np.ndarray | None = None, seed: int = 42, free: int = 0):
        self.width, self.hidden, self.free = width, hidden, free
        if weights is None:
            rng = np.random.default_rng(seed)
            weights = np.concatenate([rng.normal(0, (2 / width) ** 0.5, width * hidden), np.zeros(hidden), rng.normal(0, (2 / hidden) ** 0.5, hidden), np.zeros(1), rng.normal(0, 1, free)])
        self.weights = weights

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        at = np.cumsum([self.width * self.hidden, self.hidden, self.hidden, 1])
        w, b, v, c, u = np.split(self.weights, at)
        return w.reshape(self.width, self.hidden), b, v, c, u

    def places(self) -> list[slice]:
        return [slice(self.free, 2 * self.free), slice(3 * self.free, 4 * self.free)]

    def filled(self, x: np.ndarray, free: np.ndarray | None) -> np.ndarray:
        """x with the learned vector for free heads and tails."""
        if not self.free or free is None:
            return x
        x = np.array(x, float)
        for i, at in enumerate(self.places()):
            x[:, at] += np.outer(free[:, i], self.parts()[4])
        return x

    def logits(self, x: np.ndarray, free: np.ndarray | None = None) -> np.ndarray:
        w, b, v, c, _ = self.parts()
        return np.maximum(self.filled(x, free) @ w + b, 0) @ v + c

    def gradient(self, x: np.ndarray, y: np.ndarray, free: np.ndarray | None = None) -> np.ndarray:
        """Sums over rows of the weights' gradient of binary cross-entropy, that of the learned vector over all places where
        it stands; the loss and the number of rows come last."""
        w, b, v, c, u = self.parts()
        x = self.filled(x, free)
        h = np.maximum(x @ w + b, 0)
        z = h @ v + c
        d = 1 / (1 + np.exp(-z)) - y
        dh = np.outer(d, v) * (h > 0)
        loss = (np.logaddexp(0, z) - y * z).sum()
        du = np.zeros(len(u))
        if self.free and free is not None:
            dx = dh @ w.T
            du = sum(free[:, i] @ dx[:, at] for i, at in enumerate(self.places()))
        return np.concatenate([(x.T @ dh).ravel(), dh.sum(0), h.T @ d, [d.sum()], du, [loss, len(y)]])


def _inputs(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray | None]:
    return np.stack(frame["x"]), np.stack(frame["free"]) if "free" in frame else None


def _columns(rows: DataFrame, *names: str) -> list[str]:
    return [*names, *(c for c in ("free",) if c in rows.columns)]


def scored(rows: DataFrame, network: Network) -> DataFrame:
    """sample_id, triple_id, score in (0, 1)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            z = network.logits(*_inputs(frame)) if len(frame) else np.zeros(0)
            yield pd.DataFrame({"sample_id": frame["sample_id"], "triple_id": frame["triple_id"], "score": 1 / (1 + np.exp(-z))})

    kind = lambda c: f"{c} {rows.schema[c].dataType.simpleString()}"
    return rows.select(_columns(rows, "sample_id", "triple_id", "x")).mapInPandas(run, f"{kind('sample_id')}, {kind('triple_id')}, score double")


def gradient(rows: DataFrame, network: Network) -> np.ndarray:
    """The sum over all rows, in a tree of vectors: tasks add up their batches, about as many tasks as the root of their
    number add up these sums, and the driver the rest. A vector is one row, so none has a row for each weight."""

    def own(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            if len(frame):
                x, free = _inputs(frame)
                g = network.gradient(x, frame["label"].to_numpy(float), free)
                total = g if total is None else total + g
        if total is not None:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "g": [total.tobytes()]})

    def added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            for raw in frame["g"]:
                g = np.frombuffer(raw)
                total = g if total is None else total + g
        if total is not None:
            yield pd.DataFrame({"part": [0], "g": [total.tobytes()]})

    groups = max(1, math.isqrt(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    vectors = rows.select(_columns(rows, "x", "label")).mapInPandas(own, "part int, g binary")
    out = np.zeros(len(network.weights) + 2)
    for r in vectors.repartition(groups, "part").mapInPandas(added, "part int, g binary").collect():
        out += np.frombuffer(r.g)
    return out


def save(spark: SparkSession, network: Network, path: str) -> None:
    """One row: width, hidden, weights, free."""
    spark.createDataFrame([(int(network.width), int(network.hidden), [float(x) for x in network.weights], int(network.free))], "width int, hidden int, weights array<double>, free int").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Network:
    row = spark.read.parquet(path).first()
    return Network(row.width, row.hidden, np.array(row.weights), free=row.free)


def train(
    rows: DataFrame, labels: DataFrame, triples: DataFrame, hidden: int = 64, rate: float = 1e-3, epochs: int = 10000, patience: int = 10, k: int = 100, seed: int = 42, batches: int = 1, free: int = 0
) -> tuple[Network, list[tuple[float, float]]]:
    """The network with the best recall of labelled triples among the first k, and (recall, loss) of each epoch.

    rows: features; free: the length of the learned vector for entities without text. Questions are dealt to batches by a
    hash, a folder each. An epoch measures recall, then takes a step of Adam on the mean over each batch's rows, the
    batches in an order of its own; it ends when patience epochs bring nothing better. With as many batches as questions
    that is about a step for each question. Only vectors as long as the weights reach the driver."""
    spark, folder = rows.sparkSession, records.scratch(rows.sparkSession)
    both = rows.join(labels.select("sample_id", "triple_id", "label"), ["sample_id", "triple_id"])
    both.withColumn("batch", F.pmod(F.xxhash64("sample_id", F.lit(seed)), F.lit(batches)).cast("int")).write.partitionBy("batch").parquet(folder)
    own = spark.read.schema(both.withColumn("batch", F.lit(0)).schema).parquet(folder)
    first = own.select(F.size("x").alias("n")).first()
    if first is None:
        raise ValueError("no triples to learn from")
    full = sorted(r.batch for r in own.select("batch").distinct().collect())
    relevant = labels.where("label > 0").join(triples.select("sample_id", "triple_id", "h", "r", "t"), ["sample_id", "triple_id"])
    net = Network(first.n, hidden, seed=seed, free=free)
    m, v, best, kept, history, stale, n = np.zeros(len(net.weights)), np.zeros(len(net.weights)), -1.0, net.weights.copy(), [], 0, 0
    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        recall = retrieval.triple_recall(retrieval.ranked(triples.drop("score").join(scored(own, net), ["sample_id", "triple_id"])), relevant, [k]).first().recall or 0.0
        if recall > best:
            best, kept, stale = recall, net.weights.copy(), 0
        else:
            stale += 1
        loss = 0.0
        for batch in draw.permutation(full):
            g = gradient(own.where(F.col("batch") == int(batch)), net)
            mean = g[:-2] / max(g[-1], 1)
            loss += g[-2] / max(g[-1], 1) / len(full)
            n += 1
            m, v = 0.9 * m + 0.1 * mean, 0.999 * v + 0.001 * mean**2
            net = Network(net.width, hidden, net.weights - rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.999**n)) + 1e-8), free=free)
        history.append((recall, loss))
        if stale >= patience:
            break
    return Network(net.width, hidden, kept, free=free), history
