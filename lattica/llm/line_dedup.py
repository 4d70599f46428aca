"""Line dedup with two Bloom filters: one of line keys seen once, one of keys seen again.

A first pass over the texts hashes the keys of each task's documents, and the hash space is dealt to slices. A slice streams its
hashes past both filters: what the first one knows already enters the second. The second, of a bounded size, is
broadcast, and a second pass lets only the lines that it knows, the suspected repeats, shuffle: by 256-bit digests of
their keys, for an exact count of documents and the choice of the one that keeps its lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import base
from lattica.llm.shingles import LOWER

LEAST_CHARS, DOCUMENTS = 40, 5
BLANKS = " \t\n\x0b\x0c\r"
#: Bits of a filter for each key, and probes; at that load one new key in 3e5 passes for a seen one.
BITS, PROBES = 16, 3
#: Most bytes of the broadcast filter. Beyond 2**24 keys the load rises, so more lines are suspected; results stay exact.
FILTER_BYTES = 32 << 20
#: Slices of the hash space, and hashes that a task holds before it sends them.
SLICES, HELD = 256, 1 << 20


def line_keys(text: str, least: int) -> list[bytes | None]:
    """The key of each line, None where it has fewer than least code points."""
    return [k.encode("utf-8", "surrogatepass").translate(LOWER) if len(k := line.strip(BLANKS)) >= least else None for line in text.split("\n")]


def probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES places in a slice's filter for each hash; bits is a power of two."""
    return np.stack([base.mix(hashes + np.uint64(i)) & np.uint64(bits - 1) for i in range(PROBES)], 1).astype(np.int64)


def hashes_of(docs: DataFrame, least: int) -> DataFrame:
    """slice, hashes (64 bits each, distinct), again (a bit each: in several documents of the task), n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            every, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            own = (every >> np.uint64(56)).astype(np.int64)
            at = np.searchsorted(own, np.arange(SLICES + 1))
            full = np.flatnonzero(np.diff(at))
            yield pa.RecordBatch.from_arrays([
                pa.array(full, pa.int32()), pa.array([every[at[i] : at[i + 1]].tobytes() for i in full], pa.binary()),
                pa.array([np.packbits(n[at[i] : at[i + 1]] > 1).tobytes() for i in full], pa.binary()), pa.array(np.diff(at)[full], pa.int64()),
            ], names=["slice", "hashes", "again", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = {xxhash.xxh3_64_intdigest(k) for k in line_keys(text, least) if k is not None}
                if found:
                    held.append(np.fromiter(found, np.uint64, len(found)))
                    size += len(found)
                if size >= HELD:
                    yield from sent()
                    held, size = [], 0
        yield from sent()

    return docs.where("doc_id is not null and text is not null").select("text").mapInArrow(run, "slice int, hashes binary, again binary, n long")


def seen_again(parts: DataFrame, bits: int) -> DataFrame:
    """slice, filter: the second filter of each slice, whose hashes stream past both. parts: of hashes_of()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, twice = None, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(twice).tobytes()], pa.binary())], names=["slice", "filter"])

        for batch in batches:
            for part, raw, flags, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if part != at:
                    if at is not None:
                        yield done()
                    at, once, twice = part, np.zeros(bits, bool), np.zeros(bits, bool)
                place = probes(np.frombuffer(raw, np.uint64), bits)
                known = once[place].all(1) | np.unpackbits(np.frombuffer(flags, np.uint8), count=n).astype(bool)
                twice[place[known].ravel()] = True
                once[place.ravel()] = True
        if at is not None:
            yield done()

    spark = parts.sparkSession
    return parts.repartition(base.partitions(spark), "slice").sortWithinPartitions("slice").mapInArrow(run, "slice int, filter binary")


def suspected(docs: DataFrame, filters: np.ndarray, bits: int, least: int) -> DataFrame:
    """doc_id, key: digests of the lines that the second filter knows, once for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            rows, keys = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = {k for k in line_keys(text, least) if k is not None}
                rows += [i] * len(own)
                keys += own
            hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
            place = probes(hashes, bits)
            part = (hashes >> np.uint64(56)).astype(np.int64)[:, None]
            good = np.flatnonzero((known[part, place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).all(1)).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([rows[i] for i in good], pa.int64())), pa.array([digest(keys[i]) for i in good], pa.binary())], names=["doc_id", "key"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, key binary")


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=32).digest()


def kept_lines(docs: DataFrame, gone: DataFrame, least: int) -> DataFrame:
    """docs without the lines whose keys gone (doc_id, keys) names: doc_id, text, n_lines, n_dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, dropped = [], [], []
            for text, keys in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = text or ""
                n, out = text.count("\n") + 1, 0
                if keys:
                    going = set(keys)
                    kept = [line for line, k in zip(text.split("\n"), line_keys(text, least), strict=True) if k is None or digest(k) not in going]
                    text, out = "\n".join(kept), n - len(kept)
                texts.append(text)
                lines.append(n)
                dropped.append(out)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=["doc_id", "text", "n_lines", "n_dropped"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").join(gone, "doc_id", "left").select("doc_id", "text", "keys").mapInArrow(run, f"doc_id {kind}, text string, n_lines long, n_dropped long")


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, documents: int = DOCUMENTS, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, text (what stays), n_lines (before), n_dropped, a row for each row of docs.

    A key is a line without blanks at its ends, A-Z lower-cased. Keys of at least least_chars code points in at least
    documents documents lose their lines everywhere but in the largest doc_id. Rows that repeat a doc_id are one
    document for the count, and all of them keep their lines if it is the largest. A row without doc_id is no document: it keeps its
    lines and counts for none. A null text is one empty line. An empty table gives none."""
    spark = docs.sparkSession
    folder = base.scratch(spark) + "/lines"
    parts = base.written(hashes_of(docs, least_chars), f"{folder}/hashes")
    n = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = 1 << max(6, min((BITS * n // SLICES).bit_length(), (8 * filter_bytes // SLICES).bit_length() - 1))
    filters = np.zeros((SLICES, bits // 8), np.uint8)
    for row in seen_again(parts, bits).collect():  # SLICES rows, filter_bytes in all at most
        filters[row["slice"]] = np.frombuffer(row["filter"], np.uint8)
    suspects = base.written(suspected(docs, filters, bits, least_chars), f"{folder}/suspects")
    counted = suspects.groupBy("key").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= documents).select("key", "keeper")
    confirmed = base.written(counted, f"{folder}/confirmed")
    gone = suspects.join(confirmed, "key").where("doc_id < keeper").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    return kept_lines(docs, gone, least_chars)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(base.table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def oracle() -> str:
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) l from documents),
e as (select doc_id, unnest(l) line, generate_subscripts(l, 1) i from d),
k as (select doc_id, i, line, translate(trim(line, {blanks}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k from e),
g as (select k, max(doc_id) keeper from k where length(k) >= {LEAST_CHARS} group by k having count(distinct doc_id) >= {DOCUMENTS}),
x as (select k.doc_id, i, line, coalesce(k.doc_id < keeper, false) gone from k left join g using (k))
select doc_id, count(*)::bigint as n_lines, (count(*) filter (gone))::bigint as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from x group by doc_id"""
