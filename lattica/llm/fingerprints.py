"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the k smallest hashes of a text's distinct shingles, in order. Sketches of parts merge into that of the
whole; two of them estimate resemblance, containment and, from the kth hash, the number of distinct shingles. Sets of
k shingles or fewer are kept whole, so that their figures are exact.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import base, shingles

K, WORDS = 128, 5
#: Rows whose ids give the cut points of a partitioning, for each partition.
CUTS = 20


def sketches(texts: list[bytes], k: int = K, words: int = WORDS) -> list[np.ndarray]:
    return [s[:k].copy() for s in shingles.shingle_sets(texts, words)]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of common shingles among all of both; 1 for two empty sketches."""
    both = merge(a, b, k)
    if not len(both):
        return 1.0
    return float((np.isin(both, a, assume_unique=True) & np.isin(both, b, assume_unique=True)).sum() / len(both))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def shown(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u8")


def fingerprints(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, fingerprint, n_distinct (estimated). Null and wordless texts have the empty
    fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = base.utf8(batch.column(1))
            for a, b in base.chunks(texts):
                found = sketches(texts[a:b], k, words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([shown(x) for x in found]), pa.array([distinct(x, k) for x in found])], names=["doc_id", "fingerprint", "n_distinct"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint string, n_distinct double")


def merged(prints: DataFrame, key: str, k: int = K) -> DataFrame:
    """prints: key, fingerprint. One fingerprint for each key, that of its texts together. Each task merges its own
    part first, so a hot key sends a row from each task."""

    rows = prints.select(key, "fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for name, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[name] = merge(held[name], read(x), k) if name in held else read(x)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), kind), pa.array([shown(x) for x in held.values()], pa.string())], names=[key, "fingerprint"])

    return rows.mapInArrow(run, rows.schema).repartition(base.partitions(prints.sparkSession), key).mapInArrow(run, rows.schema)


def cut_points(docs: DataFrame, n: int) -> np.ndarray:
    """At most n - 1 ids that part the rows about evenly, from a bounded choice of ids by hash."""
    ids = docs.where("doc_id is not null").select("doc_id")
    every = max(1, ids.count() // (CUTS * n))
    some = sorted(r[0] for r in ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).collect())
    return np.unique([some[len(some) * i // n] for i in range(1, n)]) if some else np.zeros(0, np.int64)


def followed(docs: DataFrame) -> DataFrame:
    """part, last, doc_id, text: each part's rows in descending order are followed by the row that comes next in
    another part (last = 1), so a task sees every row with its successor. Text moves once."""
    n = base.partitions(docs.sparkSession)
    cuts = cut_points(docs, n)

    @F.pandas_udf("int")
    def part_of(x: pd.Series) -> pd.Series:
        return pd.Series(len(cuts) - np.searchsorted(cuts, x.to_numpy(), "right"), dtype="int32")

    placed = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    heads = {r["part"]: r["head"] for r in placed.select("doc_id").withColumn("part", part_of("doc_id")).groupBy("part").agg(F.max("doc_id").alias("head")).collect()}
    order = sorted(heads)
    # A row for each partition at most.
    following = docs.sparkSession.createDataFrame([(order[i - 1], heads[p]) for i, p in enumerate(order)], "part int, doc_id long")
    ends = placed.join(F.broadcast(following), "doc_id").groupBy("part", "doc_id").agg(F.min("text").alias("text"))
    rows = placed.withColumn("part", part_of("doc_id")).select("part", F.lit(0).alias("last"), "doc_id", "text").unionByName(ends.select("part", F.lit(1).alias("last"), "doc_id", "text"))
    return rows.repartitionById(max(1, len(cuts) + 1), "part").sortWithinPartitions("part", "last", F.desc("doc_id"), "text")


def op6(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """The contract's columns. docs: doc_id, text. Rows that repeat an id come in order of their texts, so the next
    document of one may be its repetition. A row without id has no place in the order and is its own next document, as
    the only row of a table is."""

    def compared(rows: list[tuple[int, str]], after: list[str]) -> pa.RecordBatch:
        texts = [t for _, t in rows]
        cut = [len(t) // 3 for t in texts]
        edited = [t[: len(t) - c] + x[:c] for t, x, c in zip(texts, after, cut, strict=True)]
        raw = [[x.encode("utf-8", "surrogatepass") for x in many] for many in (texts, edited, after[-1:])]
        own, other, tail = (sketches(x, k, words) for x in raw)
        # Successors follow in the batch but for the last.
        following = [own[i + 1] if i + 1 < len(rows) and after[i] == texts[i + 1] else (tail[0] if i + 1 == len(rows) else sketches([after[i].encode()], k, words)[0]) for i in range(len(rows))]
        return pa.RecordBatch.from_arrays([
            pa.array([i for i, _ in rows], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw[1]]),
            pa.array([shown(x) for x in own]), pa.array([shown(x) for x in other]), pa.array([resemblance(a, b, k) for a, b in zip(own, other, strict=True)], pa.float64()),
            pa.array([resemblance(a, b, k) for a, b in zip(own, following, strict=True)], pa.float64()),
        ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, size = [], None, 0
        for batch in batches:
            for part, last, name, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held and (last or size > base.CHUNK_BYTES):
                    yield compared(held, [t for _, t in held[1:]] + [text])
                    held, size = [], 0
                if not last:
                    held.append((name, text))
                    size += len(text)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(1).to_pylist():
                yield compared([(None, text or "")], [text or ""])

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return followed(docs).mapInArrow(run, schema).unionByName(docs.where("doc_id is null").select("doc_id", "text").mapInArrow(alone, schema))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6(base.table(spark, sf_dir, "documents"))
