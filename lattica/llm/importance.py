"""Importance resampling towards a target distribution, over an integer word dictionary.

Texts are coded chunk by chunk with local word numbers. A dictionary maps the distinct words of all chunks to ids, and
n-grams become tuples of ids; a single word's tuple is its dictionary entry. Each distinct tuple's bytes are put together
again and hashed once, to its bucket; counts of tuples add up to those of buckets, and the buckets' gains are joined back
to the words and tuples of each chunk. A document's weight is the sum of its features' gains; Gumbel noise by document
makes the highest scores a weighted draw without replacement.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm import base
from lattica.llm.decontaminate import formed

BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 2024, 10, 20
#: Bytes of text that share local word numbers; a longer single text stands alone. Pieces that are split into words at once.
CHUNK_BYTES, PIECE = 16 << 20, 1 << 20
#: Rows of an Arrow batch of tuples.
ROWS = 10_000
CODED = "chunk long, target boolean, words array<string>, counts array<long>, sizes array<int>, tuples binary, totals binary, doc_ids array<{kind}>, n_words array<long>, n_features array<long>, features binary"


class Numbers(dict):
    """Words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def word_numbers(text: bytes, numbers: Numbers) -> np.ndarray:
    text, at, out = formed(text), 0, []
    while at < len(text):
        end = len(text) if len(text) - at <= PIECE else text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        out.append(np.fromiter(map(numbers.__getitem__, text[at:end].split()), np.int32))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def grams(texts: list[np.ndarray], words: int, low: int, high: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The distinct runs of low to high words, a table of word numbers for each length, and each text's runs as
    numbers of them, counted on from length to length. A run of one word has the word's number."""
    lengths = np.array([len(x) for x in texts], np.int64)
    flat = np.concatenate(texts).astype(np.int64) if texts else np.zeros(0, np.int64)
    ends = np.repeat(np.cumsum(lengths), lengths)
    of = np.repeat(np.arange(len(texts)), lengths)
    at, no, tables, found, first = np.arange(len(flat)), flat, [], [], 0
    table = np.arange(words)[:, None]
    for n in range(1, high + 1):
        if n > 1:
            fits = at + n <= ends[at]
            keys, no = np.unique(no[fits] * words + flat[at[fits] + n - 1], return_inverse=True)
            at = at[fits]
            table = np.concatenate([table[keys // max(words, 1)], (keys % max(words, 1))[:, None]], 1)
        if n >= low:
            tables.append(table.astype(np.int32))
            found.append((of[at], no + first))
            first += len(table)
    owner, every = (np.concatenate([x[i] for x in found]) for i in (0, 1))
    order = np.argsort(owner, kind="stable")
    cut = np.searchsorted(owner[order], np.arange(1, len(texts)))
    return tables, np.split(every[order], cut) if texts else []


def packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32: their lower halves, then their upper ones, which are mostly 0."""
    return numbers.astype("<u4").view("<u2").reshape(-1, 2).T.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, "<u2").reshape(2, -1).T).view("<u4").ravel()


def coded(rows: DataFrame, low: int, high: int) -> DataFrame:
    """rows: target, doc_id, text. A row for each chunk of texts: its words and how often each occurs, the tuples of two
    and more local word numbers (sizes: how many of each length; totals: how often each), and each text's features as
    numbers of words and, counted on, of tuples."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        numbers, names, texts, size, side = Numbers(), [], [], 0, None

        def chunk() -> pa.RecordBatch:
            tables, found = grams(texts, len(numbers), low, high)
            every = np.concatenate(found)
            total = np.bincount(every, minlength=sum(map(len, tables)))
            single, tables = (len(numbers), tables[1:]) if low == 1 else (0, tables)
            row = {
                "chunk": (part << 32) + made, "target": side, "words": [w.decode("utf-8", "surrogatepass") for w in numbers], "counts": total[:single] if single else np.zeros(len(numbers), np.int64),
                "sizes": [len(x) for x in tables], "tuples": b"".join(x.astype("<i4").tobytes() for x in tables), "totals": total[single:].astype("<i8").tobytes(),
                "doc_ids": names, "n_words": [len(x) for x in texts], "n_features": [len(x) for x in found], "features": packed(every),
            }
            kinds = {"chunk": pa.int64(), "target": pa.bool_(), "words": pa.list_(pa.string()), "counts": pa.list_(pa.int64()), "sizes": pa.list_(pa.int32()), "doc_ids": pa.list_(name_kind), "n_words": pa.list_(pa.int64()), "n_features": pa.list_(pa.int64())}
            return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()], names=list(row))

        for batch in batches:
            name_kind = batch.column(1).type
            for target, name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), base.utf8(batch.column(2)), strict=True):
                if names and (target != side or size + len(text) > CHUNK_BYTES):
                    yield chunk()
                    made += 1
                    numbers, names, texts, size = Numbers(), [], [], 0
                side = target
                names.append(name)
                texts.append(word_numbers(text, numbers))
                size += len(text)
        if names:
            yield chunk()

    return rows.select("target", "doc_id", "text").mapInArrow(run, CODED.format(kind=kind))


def chunk_tuples(chunks: DataFrame, ids: DataFrame, low: int) -> DataFrame:
    """chunk, no (the tuple's number there, behind the words' where low is 1), target, tuple (dictionary ids), n. ids:
    chunk, ids of its words in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, target, sizes, tuples, totals, names in zip(*(batch.column(i).to_pylist() for i in range(5)), batch.column(5), strict=True):
                names = np.zeros(0, np.int64) if names.values is None else names.values.to_numpy()
                local, totals, first, before = np.frombuffer(tuples, "<i4"), np.frombuffer(totals, "<i8"), 0, len(names) if low == 1 else 0
                for width, n in enumerate(sizes, max(low, 2)):
                    some, local = names[local[: n * width]], local[n * width :]
                    for a in range(0, n, ROWS):
                        e = min(n, a + ROWS)
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(e - a + 1) * width, pa.int32()), pa.array(some[a * width : e * width], pa.int64()))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(e - a, chunk)), pa.array(np.arange(before + first + a, before + first + e), pa.int32()), pa.array([target] * (e - a), pa.bool_()), lists, pa.array(totals[first + a : first + e])], names=["chunk", "no", "target", "tuple", "n"])
                    first += n

    cols = ["chunk", "target", "sizes", "tuples", "totals"]
    return chunks.select(cols).join(ids, "chunk", "left").select(*cols, "ids").mapInArrow(run, "chunk long, no int, target boolean, tuple array<long>, n long")


def sides() -> list[Column]:
    """s and t: the sums of n in the documents and in the target."""
    return [F.coalesce(F.sum(F.when(side, F.col("n"))), F.lit(0)).alias(c) for c, side in (("s", ~F.col("target")), ("t", F.col("target")))]


def bucket_of(text: str, buckets: int) -> Column:
    return F.pmod(F.crc32(F.col(text).cast("binary")), F.lit(buckets)).cast("int")


def hashed(tuples: DataFrame, dictionary: DataFrame, high: int, buckets: int) -> DataFrame:
    """tuple, bucket, s and t (how often it occurs in the documents and in the target), each tuple once. Its words come
    from the dictionary (word, id), place by place; the bytes of the words, joined by blanks, are hashed."""
    every = tuples.groupBy("tuple").agg(*sides())
    for i in range(high):
        every = every.withColumn("id", F.get("tuple", F.lit(i))).join(dictionary.select("id", F.col("word").alias(f"word{i}")), "id", "left").drop("id")
    every = every.withColumn("text", F.concat_ws(" ", *[f"word{i}" for i in range(high)]))
    return every.select("tuple", bucket_of("text", buckets).alias("bucket"), "s", "t")


def gains_of(hashes: DataFrame, buckets: int) -> DataFrame:
    """hashes: bucket, s, t. bucket, gain: floor(1000 ln) of the smoothed ratio of the bucket's shares in the target and in
    the documents."""
    counts = hashes.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    every = counts.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    over = (F.col("t") + 1).cast("double") * F.lit(float(every["s"] + buckets))
    under = (F.col("s") + 1).cast("double") * F.lit(float(every["t"] + buckets))
    return counts.select("bucket", F.floor(1000 * F.log(over / under)).alias("gain"))


def weighed(chunks: DataFrame, gains: DataFrame) -> DataFrame:
    """doc_id, n_words, n_features, weight of the chunks' documents. gains: chunk, gains of its tuples by number."""
    kind = chunks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in enumerate(batch.column(3).to_pylist()):
                names, words, counts, gain = (batch.column(j)[i].values for j in (0, 1, 2, 4))
                gain = np.zeros(0, np.int64) if gain is None else gain.to_numpy()
                total = np.concatenate([[0], np.cumsum(gain[unpacked(raw)])])
                at = np.concatenate([[0], np.cumsum(counts.to_numpy())])
                yield pa.RecordBatch.from_arrays([names, words, counts, pa.array(total[at[1:]] - total[at[:-1]], pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    cols = ["doc_ids", "n_words", "n_features", "features"]
    return chunks.where("not target").join(gains, "chunk", "left").select(*cols, "gains").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def weights(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, low: int = 1, high: int = 1) -> DataFrame:
    """docs: doc_id, text; target: text. Returns doc_id, n_words, n_features, weight, a row for each row of docs.

    Features are all runs of low to high words, repeats counted. Null and wordless texts have none and weigh 0. Rows
    that repeat an id, or have none, are texts like others. An empty target leaves each bucket its smoothing."""
    spark = docs.sparkSession
    folder = base.scratch(spark) + "/importance"
    kind = docs.schema["doc_id"].dataType
    rows = docs.select(F.lit(False).alias("target"), "doc_id", "text").unionByName(target.select(F.lit(True).alias("target"), F.lit(None).cast(kind).alias("doc_id"), "text"))
    chunks = base.written(coded(rows, low, high), f"{folder}/chunks")
    words = chunks.select("chunk", "target", F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "x")).select("chunk", "target", "pos", "x.words", "x.counts").toDF("chunk", "target", "pos", "word", "n")
    dictionary = words.groupBy("word").agg(*sides()).withColumn("id", F.monotonically_increasing_id()).withColumn("bucket", bucket_of("word", buckets))
    dictionary = base.written(dictionary, f"{folder}/dictionary")
    in_order = lambda value: F.transform(F.sort_array(F.collect_list(F.struct("pos", value))), lambda x: x[value])
    every, own = [], []
    if low == 1:
        every.append(dictionary.select("bucket", "s", "t"))
        own.append(words.where("not target").join(dictionary.select("word", "bucket"), "word").select("chunk", "pos", "bucket"))
    if high > 1:
        ids = words.join(dictionary, "word").groupBy("chunk").agg(in_order("id").alias("ids"))
        tuples = base.written(chunk_tuples(chunks, ids, low), f"{folder}/tuples")
        distinct = base.written(hashed(tuples, dictionary, high, buckets), f"{folder}/distinct")
        every.append(distinct.select("bucket", "s", "t"))
        own.append(tuples.where("not target").join(distinct.select("tuple", "bucket"), "tuple").select("chunk", F.col("no").alias("pos"), "bucket"))
    gains = base.written(gains_of(reduce(DataFrame.unionByName, every), buckets), f"{folder}/gains")
    return weighed(chunks, reduce(DataFrame.unionByName, own).join(gains, "bucket").groupBy("chunk").agg(in_order("gain").alias("gains")))


def drawn(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """rows: doc_id, n_words, weight and others. Adds score and rank (null if not drawn).

    score is the weight plus floor(1000 g), g a Gumbel draw from the seed and the id. Of the rows with least_words words
    and an id, percent in a hundred are drawn, rounded down, by falling score, ties by smaller id; rows that repeat both
    have different ranks. A row without id has no score. Rows are ranked in ranges of the order, each counted on from
    the ranges before it, so none has to hold them all."""
    spark = rows.sparkSession
    folder = base.scratch(spark) + "/drawn"
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = rows.withColumn("score", F.col("weight") + noise).withColumn("able", F.coalesce((F.col("n_words") >= least_words) & F.col("doc_id").isNotNull(), F.lit(False)))
    scored = base.written(scored, f"{folder}/scored")
    order = [F.desc("score"), F.asc("doc_id")]
    able = scored.where("able").repartitionByRange(base.partitions(spark), *order).withColumn("part", F.spark_partition_id())
    able = base.written(able, f"{folder}/able")
    total, first, cuts = 0, {}, able.groupBy("part").count().collect()  # a row for each partition
    for r in sorted(cuts):
        first[r["part"]], total = total, total + r["count"]
    starts = spark.createDataFrame(list(first.items()), "part int, first long")
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("first")
    ranked = able.join(F.broadcast(starts), "part").withColumn("rank", place)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= percent * total // 100, F.col("rank")))
    return ranked.select(*scored.columns, "rank").unionByName(scored.where("not able").withColumn("rank", F.lit(None).cast("long"))).drop("able")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drawn(weights(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def oracle() -> str:
    """crc32 by its table of 256 remainders, once for each distinct word."""
    words = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return f"""with c as (select list(list_reduce(range(8), lambda r, _: case when r & 1 = 1 then xor(r >> 1, 3988292384) else r >> 1 end, i) order by i) crc from range(256) g(i)),
d as (select doc_id, {words} w from documents), b as (select {words} w from benchmark),
x as (select doc_id, unnest(w) word from d), y as (select unnest(w) word from b),
n as (select word, sum(s)::bigint s, sum(t)::bigint t from (select word, count(*) s, 0 t from x group by 1 union all select word, 0, count(*) from y group by 1) group by 1),
h as (select word, s, t, xor(list_reduce(list_transform(range(1, octet_length(encode(word)) + 1), lambda i: ('0x' || substr(hex(encode(word)), (2 * i - 1)::int, 2))::bigint), lambda r, o: xor(r >> 8, crc[(xor(r, o) & 255)::int + 1]), 4294967295), 4294967295) % {BUCKETS} bucket from n, c),
k as (select bucket, sum(s) s, sum(t) t from h group by 1),
g as (select bucket, floor(1000 * ln((t + 1)::double * ((select sum(s) from k) + {BUCKETS})::double / ((s + 1)::double * ((select sum(t) from k) + {BUCKETS})::double)))::bigint gain from k),
e as (select doc_id, sum(gain)::bigint weight from x join h using (word) join g using (bucket) group by 1),
f as (select doc_id, len(w)::bigint n_features, coalesce(weight, 0)::bigint weight, ('0x' || sha256('{SEED}:' || doc_id)[1:8])::bigint h from d left join e using (doc_id)),
s as (select doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5)::double / 4294967296)))::bigint score from f),
r as (select *, row_number() over (partition by n_features >= {LEAST_WORDS} order by score desc, doc_id) p, count(*) over (partition by n_features >= {LEAST_WORDS}) n from s)
select doc_id, n_features, weight, score, case when n_features >= {LEAST_WORDS} and p <= {PERCENT} * n // 100 then p end as rank from r"""
