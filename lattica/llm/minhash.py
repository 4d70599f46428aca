"""Near-duplicates: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidates.

1. Each document's shingle set becomes a 128-bit set hash, a one-permutation signature and its bands' keys. Documents
   with equal sets are one node from here on, so groups of copies of any size cost one row.
2. Buckets: nodes with an equal band key. Candidates are stars: every member with the bucket's smallest node. Minima
   are pre-aggregated; the join back to the members is one that Spark splits where a bucket is hot.
3. Candidates whose sizes or signatures can't reach the threshold go (see reachable); the others are confirmed on
   full sets.
4. A star may miss a link between two members. So in buckets whose members are not in one component, members outside
   the bucket's main component are held, by signature, against the bucket; first only their best matches are
   confirmed, then, with these components joined, all that are left. A bucket with many such members, say of one
   boilerplate text in else different documents, is held in blocks of bounded size, each against the members whose sizes
   allow a link. No pair is left out, so that work grows as the square of such members of like sizes.

With r rows and b bands a pair at similarity s shares no bucket with probability (1 - s**r)**b: 3e-7 at the threshold
for both settings below. The signatures' bound gives up one of 10**7 pairs at the threshold (see FAR). Components come from large and small stars over tables in the shared folder.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import base, components, shingles

BINS = 384
#: Members of a bucket that are held against the others at once.
BLOCK = 2048
BEST = 2
#: Standard deviations that an estimate may lie below the threshold. By the exact binomial tail of all bins, large sets at
#: 0.85 or 0.8 lie lower with a probability of 1.2e-7.
FAR = 5.5
SIGNED = "doc_id long, n_shingles long, node long, node2 long, signature binary, bands array<long>"


def banding(threshold: float) -> tuple[int, int]:
    """(rows of a band, bands)."""
    return (6, 32) if threshold >= 0.85 else (5, 38)


def probes(bins: int = BINS) -> np.ndarray:
    """[attempt, bin]: the bin an empty bin turns to at its nth attempt, the same for all sets."""
    t = base.mix(np.arange(bins * bins, dtype=np.uint64) + np.uint64(0x51ED270B))
    return (t % np.uint64(bins)).astype(np.int64).reshape(bins, bins)


PROBES = probes()


def signatures(sets: list[np.ndarray], bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """One-permutation minima [set, bin], densified, and which bins had a shingle of their own. Empty sets stay 0."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    of = np.repeat(np.arange(len(sets)), sizes)
    slot = of * bins + ((flat >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(slot, prepend=-1))  # sets are sorted, so a bin's first hash is its minimum
    out = np.zeros((len(sets), bins), np.uint64)
    own = np.zeros((len(sets), bins), bool)
    out.reshape(-1)[slot[first]] = flat[first]
    own.reshape(-1)[slot[first]] = True
    source = np.broadcast_to(np.arange(bins), own.shape).copy()
    todo = np.argwhere(~own & (sizes > 0)[:, None])
    for probe in PROBES:
        if not len(todo):
            break
        to = probe[todo[:, 1]]
        found = own[todo[:, 0], to]
        source[todo[found, 0], todo[found, 1]] = to[found]
        todo = todo[~found]
    for i, j in todo:  # sets of a few shingles that no attempt has met
        source[i, j] = np.flatnonzero(own[i])[j % own[i].sum()]
    return np.take_along_axis(out, source, 1), own


def band_keys(signature: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """[set, band]: the hash of the band's number and minima."""
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(shingles.BASE), (len(signature), bands)).copy()
    for j in range(rows):
        out = base.mix(out ^ signature[:, j : bands * rows : rows]) + np.uint64(j)
    return out.view(np.int64)


def signed(docs: DataFrame, k: int, threshold: float) -> DataFrame:
    """doc_id, n_shingles, node and node2 (the set's hash), signature (a byte a bin, 0 for an empty bin), bands."""
    rows, bands = banding(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = base.utf8(batch.column(1))
            for a, b in base.chunks(texts):
                sets = list(shingles.shingle_sets(texts[a:b], k))
                minima, own = signatures(sets)
                keys = band_keys(minima, rows, bands)
                short = np.where(own, (minima % np.uint64(255)).astype(np.uint8) + 1, 0).astype(np.uint8)
                ids = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8") for s in sets]).reshape(-1, 2)
                full = [len(s) > 0 for s in sets]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids[:, 0]), pa.array(ids[:, 1]),
                    pa.array([x.tobytes() if y else None for x, y in zip(short, full, strict=True)], pa.binary()), pa.array([x if y else None for x, y in zip(keys, full, strict=True)], pa.list_(pa.int64())),
                ], names=["doc_id", "n_shingles", "node", "node2", "signature", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, SIGNED)


def likeness(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of signatures [n, bins] and [m, bins]: estimated similarity [n, m] and the bins that it rests on."""
    same, both = np.zeros((len(x), len(y)), np.int32), np.zeros((len(x), len(y)), np.int32)
    step = max(1, (1 << 25) // max(1, y.size))
    for i in range(0, len(x), step):
        equal = x[i : i + step, None, :] == y[None]
        both[i : i + step] = (equal & (x[i : i + step, None, :] == 0)).sum(2, dtype=np.int32)
        same[i : i + step] = equal.sum(2, dtype=np.int32)
    used = np.maximum(x.shape[1] - both, 1)
    return (same - both) / used, used


def reachable(estimate: np.ndarray, used: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sets of n and m shingles may reach the threshold: their sizes allow it, and the estimate is less than
    FAR standard deviations below. Bins draw from the union without replacement, so the fewer shingles a bin stands
    for, the surer the estimate."""
    union = np.maximum((n + m) / (1 + threshold), 2)
    deviation = np.sqrt(threshold * (1 - threshold) / used * np.maximum(union - used, 1) / (union - 1))
    return (estimate >= threshold - FAR * deviation) & (np.minimum(n, m) >= (threshold - 1e-9) * np.maximum(n, m))


def hopeful(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs a, b whose signatures allow the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (2, 3))
                empty = ((x == 0) & (y == 0)).sum(1)
                used = np.maximum(x.shape[1] - empty, 1)
                n, m = (batch.column(c).to_numpy() for c in (4, 5))
                good = reachable(((x == y).sum(1) - empty) / used, used, n, m, threshold)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good))

    x, y = (nodes.select(F.col("node").alias(c), F.col("signature").alias(s), F.col("n").alias(f"n{s}")) for c, s in (("a", "x"), ("b", "y")))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y", "nx", "ny").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose full sets reach the threshold, in whole per cent: 100 * common >= t * union."""
    t = round(100 * threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, last, known = [], None, None
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                if (raw := x.as_py()) != last:
                    last, known = raw, np.frombuffer(raw, np.uint64)
                other = np.frombuffer(y.as_py(), np.uint64)
                less, more = sorted((known, other), key=len)
                if 100 * len(less) < t * len(more):
                    good.append(False)
                    continue
                at = np.minimum(np.searchsorted(more, less), max(len(more) - 1, 0))
                common = int((more[at] == less).sum())
                good.append(100 * common >= t * (len(less) + len(more) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    x, y = (sets.select(F.col("node").alias(c), F.col("hashes").alias(s)) for c, s in (("a", "x"), ("b", "y")))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """node, hashes of the chosen nodes (node, doc_id: the document that stands for it, node2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = base.utf8(batch.column(2))
            for a, b in base.chunks(texts):
                sets = list(shingles.shingle_sets(texts[a:b], k))
                own = pa.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8")[1] for s in sets], pa.int64())
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), own, pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "node2", "own", "hashes"])
                yield out

    found = docs.select("doc_id", "text").join(chosen.select("doc_id", "node", "node2"), "doc_id").select("node", "node2", "text").mapInArrow(run, "node long, node2 long, own long, hashes binary")
    return found.where("own = node2").select("node", "hashes").dropDuplicates(["node"])


def crossing(members: DataFrame, nodes: DataFrame, best: int | None, threshold: float, block_size: int = BLOCK, whole_buckets: bool = False) -> DataFrame:
    """Pairs of a bucket's members in different components whose signatures allow the threshold, whatever the bucket's size.

    members: key, node, label; nodes: node, signature, n (its shingles), bands. A pair comes from the first bucket that
    both are in. best: only so many matches of each node, the most similar; None: all.

    In buckets with several components the members outside the most frequent one are dealt to blocks of about block_size; a
    block is held by a task while the bucket streams past. Blocks hold one class of sizes each, and only members of that
    class or the next ones stream past, as sizes further apart can't reach the threshold; with whole_buckets all do."""
    # Sizes within the threshold of each other differ by no more than one class; the step is a bit wide for rounding.
    size = F.lit(0) if whole_buckets else F.floor(F.log("size") / F.lit(-math.log(threshold - 1e-6))).cast("int")
    near = F.array(F.lit(0)) if whole_buckets else F.array(*(F.col("class") + i for i in (-1, 0, 1)))
    counts = members.groupBy("key", "label").agg(F.count("*").alias("n"))
    main = counts.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0")
    told = members.join(main, "key").withColumn("aside", F.col("label") != F.col("main")).join(nodes.select("node", F.col("n").alias("size")), "node").withColumn("class", size)
    blocks = told.where("aside").groupBy("key", "class").agg(F.ceil(F.count("*") / block_size).cast("int").alias("blocks"))
    place = lambda df, no, kind: df.withColumns({"block": F.col("class").cast("long") * F.lit(1 << 32) + no, "kind": F.lit(kind)}).select("key", "block", "kind", "node", "label", "aside")
    mine = place(told.where("aside").join(blocks, ["key", "class"]), F.pmod(F.xxhash64("node"), F.col("blocks")), 0)
    passing = told.withColumn("class", F.explode(near)).join(blocks, ["key", "class"])
    passing = place(passing.withColumn("no", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))), F.col("no"), 1)
    n = base.partitions(members.sparkSession)
    rows = mine.unionByName(passing).join(nodes.select("node", "signature", "n", "bands"), "node").select("key", "block", "kind", "node", "label", "signature", "n", "bands", "aside")
    rows = rows.repartition(n, "key", "block").sortWithinPartitions("key", "block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block, top = None, [], None
        chunk: list = []

        def matches() -> tuple[np.ndarray, np.ndarray]:
            """Holds the block against the rows of chunk; with best, keeps the most similar so far."""
            nonlocal top, chunk
            if not (block and chunk):
                chunk = []
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            names, labels, sizes, keys, aside = (np.array([x[i] for x in chunk]) for i in (0, 1, 3, 4, 5))
            sigs = np.frombuffer(b"".join(x[2] for x in chunk), np.uint8).reshape(len(chunk), -1)
            mine, own, lengths, bands = (np.array([x[i] for x in block]) for i in (0, 1, 3, 4))
            held = np.frombuffer(b"".join(x[2] for x in block), np.uint8).reshape(len(block), -1)
            chunk = []
            estimate, used = likeness(held, sigs)
            good = reachable(estimate, used, lengths[:, None], sizes[None], threshold) & (own[:, None] != labels[None])
            good &= ~aside[None] | (mine[:, None] < names[None])  # else the other one's block has the pair
            i, j = np.nonzero(good)
            for some in np.array_split(np.arange(len(i)), len(i) // 50_000 + 1):
                same = bands[i[some]] == keys[j[some]]
                good[i[some], j[some]] = bands[i[some], same.argmax(1)] == at[0]
            if best is None:
                i, j = np.nonzero(good)
                return mine[i], names[j]
            if top is None:
                top = [[] for _ in block]
            score = np.where(good, estimate, -1.0)
            for i in np.flatnonzero(good.any(1)):
                order = np.argsort(-score[i])[:best]
                top[i] = sorted(top[i] + [(float(score[i, j]), int(names[j])) for j in order if score[i, j] >= 0], reverse=True)[:best]
            return np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out(a, b) -> pa.RecordBatch:
            a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        def ended() -> Iterator[pa.RecordBatch]:
            nonlocal top
            yield out(*matches())
            if top:
                yield out([x[0] for x, found in zip(block, top, strict=True) for _ in found], [m for found in top for _, m in found])
            top = None

        for batch in batches:
            for key, part, kind, *member in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
                if (key, part) != at:
                    yield from ended()
                    at, block = (key, part), []
                if kind == 0:
                    block.append(member)
                else:
                    chunk.append(member)
                    if len(chunk) == BLOCK:
                        yield out(*matches())
        yield from ended()

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int, threshold: float, block_size: int = BLOCK, whole_buckets: bool = False) -> DataFrame:
    """docs: doc_id, text. whole_buckets: as in crossing(). Returns doc_id, n_shingles, component_id (the smallest doc_id that links reach), kept.

    Links: |common| / |union| of the sets of k-word shingles >= threshold, in whole per cent. Documents without words
    link with nothing. A row with a null doc_id takes no part: its component is null and it is kept. Rows that repeat
    a doc_id each get the component of their own text; where that is their own id, all of them are kept."""
    spark = docs.sparkSession
    folder = base.scratch(spark) + "/near"
    rows = base.written(signed(docs, k, threshold), f"{folder}/signed")
    live = rows.where("doc_id is not null and n_shingles > 0")
    nodes = base.written(live.groupBy("node").agg(F.min_by(F.struct("doc_id", "node2", F.col("n_shingles").alias("n"), "signature", "bands"), F.struct("doc_id", "node2")).alias("x")).select("node", "x.*"), f"{folder}/nodes")

    keys = nodes.select(F.explode("bands").alias("key"), "node")
    stars = keys.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a")
    members = base.written(keys.join(stars, "key").select("key", "a", "node"), f"{folder}/members")
    pairs = members.where("node <> a").select("a", F.col("node").alias("b")).distinct()
    active = members.select("node").distinct()
    chosen = nodes.join(active, "node").select("node", "doc_id", "node2", "n", "signature", "bands")
    chosen = base.written(chosen, f"{folder}/chosen")
    sets = base.written(full_sets(docs, chosen, k), f"{folder}/sets")

    links = base.written(confirmed(hopeful(pairs, chosen, threshold), sets, threshold), f"{folder}/links0")
    labels = components.components(links, f"{folder}/c0")
    for i, best in ((1, BEST), (2, None)):
        at = members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
        more = confirmed(crossing(at, chosen, best, threshold, block_size, whole_buckets), sets, threshold)
        links = base.written(more.unionByName(links), f"{folder}/links{i}")
        labels = components.components(links, f"{folder}/c{i}")

    named = nodes.join(labels, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    where = named.join(least, "label").select("node", "component_id")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = rows.select("doc_id", "n_shingles", "node").join(where, "node", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(base.table(spark, sf_dir, "documents"), 3, 0.85)


def oracle() -> str:
    """All pairs of distinct sets that share a shingle, and their closure."""
    return r"""with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) end set from d),
n as (select set, min(doc_id) node, len(set) n from s where len(set) > 0 group by set),
e as (select node, n, unnest(set) x from n),
c as (select a.node a, b.node b, count(*) common, any_value(a.n) na, any_value(b.n) nb from e a join e b on a.x = b.x and a.node < b.node and a.n * 100 >= 85 * b.n and b.n * 100 >= 85 * a.n group by 1, 2),
l as (select a, b from c where 100 * common >= 85 * (na + nb - common)),
g as (select a, b from l union all select b, a from l),
r(node, y) as (select node, node from n union select r.node, g.b from r join g on r.y = g.a),
k as (select node, min(y) component from r group by 1)
select s.doc_id, len(s.set)::bigint as n_shingles, coalesce(k.component, s.doc_id) as component_id, coalesce(k.component, s.doc_id) = s.doc_id as kept
from s left join n on s.set = n.set left join k on k.node = n.node"""
