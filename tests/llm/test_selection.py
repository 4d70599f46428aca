"""Hard negatives, line dedup and importance resampling against brute force, with nulls, ties, repeats, empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import hard_negatives, importance, line_dedup

VECTORS = "id long, label long, vector array<double>, score string, rank string, anchor string, block string"


def brute_negatives(rows, positives, negatives, low, high, scale):
    live = [(i, k, tuple(math.floor(scale * x) for x in v)) for i, k, v in rows if i is not None and k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for i, k, v in sorted({r for r in live if r[0] % 10 == 0}):
        every = sorted((-min(max(sum(map(int.__mul__, v, w)), -(1 << 63)), (1 << 63) - 1), j, m) for j, m, w in live if j != i and len(w) == len(v))
        for s, j, m in [x for x in every if x[2] == k][:positives]:
            fits = [x for x in every if x[2] != k and low * -s <= 100 * -x[0] <= high * -s]
            yield from ((i, j, n, x[1], -s, -x[0]) for n, x in enumerate(fits[:negatives], 1))


def clustered(n, d, seed):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(8, d))
    return [(int(i), int(draw.integers(0, 3)), [float(x) for x in centres[i % 8] + 0.2 * draw.normal(size=d)]) for i in range(n)]


ODD_VECTORS = [
    (None, 1, [1.0, 2.0]), (3001, None, [1.0, 2.0]), (3002, 1, None), (3003, 1, [1.0, None]), (3004, 1, [float("nan"), 1.0]), (3005, 1, [float("inf"), 1.0]),
    (3010, 1, []), (3011, 1, []), (3012, 2, []), (3020, 1, [1.0]), (3021, 1, [2.0]), (3022, 2, [1.0]), (3023, 2, [1.0]), (3022, 2, [1.0]), (3020, 1, [1.0]), (3030, 2, [0.0, 0.0]), (3031, 2, [0.0, 0.0]), (3032, 1, [0.0, 0.0]),
]


@pytest.mark.parametrize("case", ["clustered", "odd", "same", "large", "huge"])
@pytest.mark.parametrize("leaf", [hard_negatives.LEAF, 4])
def test_hard_negatives(spark, monkeypatch, case, leaf):
    monkeypatch.setattr(hard_negatives, "LEAF", leaf)
    rows = {
        "clustered": clustered(600, 5, 1), "odd": ODD_VECTORS + clustered(60, 2, 2), "same": [(i, i % 2, [0.5, 0.25]) for i in range(300)],
        "large": [(i, k, [x * 1e6 for x in v]) for i, k, v in clustered(120, 3, 3)], "huge": [(i, k, [x * 1e14 for x in v]) for i, k, v in clustered(90, 3, 4)],
    }[case]
    table = spark.createDataFrame([(*r, "x", "y", "z", "b") for r in rows], VECTORS)
    got = hard_negatives.mine(table, F.col("id") % 10 == 0, 5, 4, 30, 90, 256)
    want = sorted(brute_negatives(rows, 5, 4, 30, 90, 256))
    assert sorted(map(tuple, got.collect())) == want and (want or case in ("same", "huge"))
    assert hard_negatives.mine(table.limit(0), F.col("id") % 10 == 0).count() == 0


def test_tree_skips_leaves_of_clustered_vectors():
    """The annulus leaves out whole leaves, and what it returns is what a scan returns."""
    draw = np.random.default_rng(5)
    x = np.repeat(draw.normal(size=(40, 8)), 100, 0) + 0.01 * draw.normal(size=(4000, 8))
    x = np.floor(4096 * x / np.linalg.norm(x, axis=1)[:, None])
    tree = hard_negatives.VantagePointTree(np.arange(4000), np.arange(4000) % 2, x)
    near, far = tree.bounds(x[:50], (x[:50] ** 2).sum(1))
    true = x[:50] @ tree.x.T
    away = np.sqrt(np.maximum((x[:50] ** 2).sum(1)[:, None] + tree.radius2 - 2 * true, 0))
    for leaf in range(len(tree.leaves)):
        d = away[:, tree.ends[leaf] : tree.ends[leaf + 1]]
        assert (near[:, leaf] <= d.min(1)).all() and (far[:, leaf] >= d.max(1)).all()
    best = np.sort(away, 1)[:, 20:21]
    assert (near > best).mean() > 0.5


def brute_lines(rows, least, documents):
    key = lambda line: re.sub("[A-Z]+", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n") if i is not None else []:
            if len(key(line)) >= least:
                held.setdefault(key(line), set()).add(i)
    gone = {k: max(v) for k, v in held.items() if len(v) >= documents}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or i >= gone.get(key(x), i)]
        yield i, "\n".join(kept), len(lines), len(lines) - len(kept)


@pytest.mark.parametrize("filter_bytes", [line_dedup.FILTER_BYTES, 1])  # 1: filters so small that most lines are suspected
def test_line_dedup(spark, filter_bytes):
    shared = ["A shared line of more than forty code points, the first.", "  Ein zweiter mit Ümlauten, länger als vierzig Zeichen, ja ", "short", "x" * 39, "X" * 40, "İ" * 40]
    draw = np.random.default_rng(1)
    rows = [(i, "\n".join([shared[j] if j < 6 else f"own line of document {i} with number {j} and more words" for j in draw.integers(0, 9, draw.integers(0, 9))])) for i in range(40)]
    rows += [(7, rows[7][1]), (None, shared[0]), (None, None), (100, None), (101, ""), (102, "\n\n"), (103, "y" * 300_000), (104, "\r\n" + shared[0].upper() + "\r\n\t" + shared[0] + "\x0b"), (-5, shared[0]), (50, "a b\x85" + shared[0])]
    table = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id long, text string, keys string, key string, n long")
    got = line_dedup.dedup_lines(table, 40, 5, filter_bytes)
    order = lambda rows: sorted(map(tuple, rows), key=str)
    want = order(brute_lines(rows, 40, 5))
    assert order(got.collect()) == want and any(r[3] for r in want)
    assert line_dedup.dedup_lines(table.limit(0)).count() == 0


def test_only_suspects_shuffle(spark):
    lines = [(i, f"a line that only the document with number {i:06d} has, {i}" if i % 10 else "the line that one document in ten has, so a repeat") for i in range(20_000)]
    docs = spark.createDataFrame(lines, "doc_id long, text string").repartition(6)
    parts = line_dedup.hashes_of(docs, 40)
    bits = 1 << 11
    filters = np.zeros((line_dedup.SLICES, bits // 8), np.uint8)
    for row in line_dedup.seen_again(parts, bits).collect():
        filters[row["slice"]] = np.frombuffer(row["filter"], np.uint8)
    suspects = line_dedup.suspected(docs, filters, bits, 40)
    assert suspects.count() < 2000 + 200 and suspects.where("doc_id % 10 = 0").count() == 2000


def brute_weights(docs, target, buckets, low, high):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    runs = lambda w: [" ".join(w[i : i + n]) for n in range(low, high + 1) for i in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in some for f in runs(split(x))) for some in ([x for _, x in docs], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    for i, x in docs:
        found = runs(split(x))
        yield i, len(split(x)), len(found), sum(gain(bucket(f)) for f in found)


def brute_draw(rows, percent, least, seed):
    out = []
    for i, words, weight in rows:
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, words, weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[0] is not None and r[1] >= least), key=lambda r: (-r[3], r[0]))
    for n, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = n
    return out


ODD_TEXTS = [(1, None), (2, ""), (3, "?!"), (4, "One two ONE two one"), (4, "One two ONE two one"), (None, "no id here"), (5, "long " * 30_000 + "end"), (6, "x" * 200_000), (7, "Ünï CÖDE x1 2 \x00 a b"), (8, "a"), (9, "a b"), (10, "a b c")]


@pytest.mark.parametrize("chunk", [importance.CHUNK_BYTES, 20])
@pytest.mark.parametrize(("low", "high"), [(1, 1), (1, 2), (2, 3)])
def test_importance_weights(spark, monkeypatch, chunk, low, high):
    monkeypatch.setattr(importance, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(importance, "PIECE", 1000)
    target = ["one two three", None, "", "a b", "ünï code"]
    docs = spark.createDataFrame([(*r, "x", 5) for r in ODD_TEXTS], "doc_id long, text string, words string, target long")
    aims = spark.createDataFrame([(t, "x") for t in target], "text string, doc_id string")
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(importance.weights(docs, aims, 50, low, high).collect()) == order(brute_weights(ODD_TEXTS, target, 50, low, high))
    assert importance.weights(docs.limit(0), aims, 50, low, high).count() == 0
    assert order(importance.weights(docs, aims.limit(0), 50, low, high).collect()) == order(brute_weights(ODD_TEXTS, [], 50, low, high))


def test_importance_draw(spark):
    draw = np.random.default_rng(2)
    rows = [(int(i), int(n), int(w)) for i, n, w in zip(range(3000), draw.integers(0, 60, 3000), draw.integers(-50, 50, 3000))] + [(None, 100, 9), (5, 100, 9), (5, 100, 9)]
    table = spark.createDataFrame(rows, "doc_id long, n_words long, weight long")
    order = lambda rows: sorted(map(tuple, rows), key=str)
    got = [(r.doc_id, r.n_words, r.weight, r.score, r["rank"]) for r in importance.drawn(table, 10, 20, 7).collect()]
    assert order(got) == order(brute_draw(rows, 10, 20, 7))
    assert importance.drawn(table.limit(0)).count() == 0
