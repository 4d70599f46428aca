"""Graph operators over edges of many samples at once: distances, shortest-path labels, directional distance encoding,
paths of one and two hops. Edges: sample_id, triple_id, h, r, t."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.sources import records


def hops(step: DataFrame, start: DataFrame, keys: list[str], both_ways: bool = False) -> DataFrame:
    """keys, node, d: hops from start (keys, node) along step (sample_id, node, to; keys hold sample_id). Level by level
    until one is empty; each level is a partition d of a table dealt by sample, so plans stay small, and steps are written
    once. both_ways: step holds each edge in both directions, so a step from a level leads to itself, the one before
    or the next one, and new nodes are told from those two levels alone."""
    spark, folder = step.sparkSession, records.scratch(step.sparkSession)
    step, levels = records.dealt(step, f"{folder}/step"), records.Levels(spark, f"{folder}/levels")
    level, d = levels.add(start.select(*keys, "node").distinct(), 0), 0
    while not level.isEmpty():
        d += 1
        seen = levels.table()
        seen = (seen.where(F.col("d") >= d - 2) if both_ways else seen).select(*keys, "node")
        new = level.join(step, ["sample_id", "node"]).select(*keys, F.col("to").alias("node")).distinct().join(seen, [*keys, "node"], "left_anti")
        level = levels.add(new, d)
    return levels.table()


def shortest_path_labels(triples: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pairs: sample_id, q, a. Returns (sample_id, triple_id, label) and (sample_id, max_path_length).

    Of the two directions between q and a the shorter counts, both if equally long; q = a has length 0 and labels
    nothing. Each way is searched from both ends: round k has level k along the edges from its start and against them
    from its end, and a way of 2k - 1 or 2k edges has a node where level k meets level k - 1 or k. So a search goes half
    as deep as its way is long, which at hubs is one level instead of two. A pair ends in the round that joins it, a way
    without a path when the level of either end is empty. Then levels are walked back from the nodes where ways meet, to
    both ends at once, so only edges of shortest paths are met and no path is listed; of equal ones the last triple's
    counts, which is settled among those met. Null ends reach nothing."""
    spark, folder = triples.sparkSession, records.scratch(triples.sparkSession)
    own = records.dealt(triples.select("sample_id", "triple_id", "h", "t"), f"{folder}/triples")
    end = lambda forward, **named: F.struct(F.lit(forward).alias("forward"), *(F.col(c).alias(k) for k, c in named.items()))
    split = lambda rows, *ends: rows.select("sample_id", F.explode(F.array(*ends)).alias("x"))
    edges = split(own, end(True, node="h", to="t", triple_id="triple_id"), end(False, node="t", to="h", triple_id="triple_id")).select("sample_id", "x.*")
    both = pairs.select("sample_id", "q", "a").distinct().withColumn("pair", F.array_sort(F.array("q", "a")))
    ways = both.select("sample_id", "pair", F.explode(F.array(F.struct(F.col("q").alias("s"), F.col("a").alias("e")), F.struct(F.col("a").alias("s"), F.col("q").alias("e")))).alias("x")).select("sample_id", "pair", "x.*").distinct()
    state = records.dealt(ways.select("*", F.when(F.col("s") == F.col("e"), 0).alias("l"), F.when(F.col("s") == F.col("e"), 0).alias("least"), F.lit(True).alias("goes_on")), f"{folder}/ways/k=0")
    roots = lambda open_: split(open_, end(True, root="s"), end(False, root="e")).select("sample_id", "x.*").distinct()
    known, every = records.Levels(spark, f"{folder}/levels"), state
    level, k, levels = known.add(roots(ways).select("*", F.col("root").alias("node")), 0), 0, known.table
    while True:
        open_ = state.where("least is null and goes_on").select("sample_id", "pair", "s", "e")
        if open_.isEmpty():
            break
        k += 1
        root = ["sample_id", "forward", "root"]
        live = level.join(roots(open_), root, "left_semi")
        new = live.join(edges, ["sample_id", "forward", "node"]).select(*root, F.col("to").alias("node")).distinct().join(levels().drop("d"), [*root, "node"], "left_anti")
        level = known.add(new, k)
        ahead = level.where("forward").select("sample_id", F.col("root").alias("s"), "node")
        behind = levels().where(~F.col("forward") & F.col("d").isin(k - 1, k)).select("sample_id", F.col("root").alias("e"), "node", "d")
        met = open_.join(ahead, ["sample_id", "s"]).join(behind, ["sample_id", "e", "node"]).groupBy("sample_id", "s", "e").agg((F.min("d") + k).alias("l"))
        left = level.where("forward").select("sample_id", F.col("root").alias("s"), F.lit(True).alias("from_s")).distinct()
        right = level.where("not forward").select("sample_id", F.col("root").alias("e"), F.lit(True).alias("from_e")).distinct()
        found = open_.join(met, ["sample_id", "s", "e"], "left").join(left, ["sample_id", "s"], "left").join(right, ["sample_id", "e"], "left")
        found = found.withColumn("least", F.min("l").over(Window.partitionBy("sample_id", "pair"))).withColumn("goes_on", F.coalesce(F.col("from_s") & F.col("from_e"), F.lit(False)))
        state = records.dealt(found.select("sample_id", "pair", "s", "e", "l", "least", "goes_on"), f"{folder}/ways/k={k}")
        every = every.unionByName(state)
    reached = every.where("l = least")
    length = reached.groupBy("sample_id").agg(F.max("l").alias("max_path_length"))
    length = pairs.select("sample_id").distinct().join(length, "sample_id", "left")
    if k == 0:
        return own.select("sample_id", "triple_id", F.lit(0.0).alias("label")), length
    at = lambda forward, name, d: levels().where(F.col("forward") == forward).select("sample_id", F.col("root").alias(name), "node", F.col("d").alias(d))
    halves = reached.where("l > 0").select("sample_id", "s", "e", F.ceil(F.col("l") / 2).cast("int").alias("ds"), F.floor(F.col("l") / 2).cast("int").alias("de"))
    middles = halves.join(at(True, "s", "ds"), ["sample_id", "s", "ds"]).join(at(False, "e", "de"), ["sample_id", "e", "node", "de"])
    middles = split(middles, end(True, root="s", to="node", d="ds"), end(False, root="e", to="node", d="de")).select("sample_id", "x.*").where("d > 0").distinct()
    middles = records.dealt(middles, f"{folder}/middles") if k > 1 else middles
    on, walked = None, None
    for d in range(k, 0, -1):  # nodes at level d where ways meet, and what the walk has come to
        ends = middles.where(F.col("d") == d).drop("d")
        ends = ends if walked is None else ends.unionByName(walked.select("sample_id", "forward", "root", F.col("node").alias("to"))).distinct()
        before = levels().where(F.col("d") == d - 1).drop("d")
        back = ends.join(edges, ["sample_id", "forward", "to"]).join(before, ["sample_id", "forward", "root", "node"])
        walked = records.dealt(back.groupBy("sample_id", "forward", "root", "node", "to").agg(F.max("triple_id").alias("triple_id")), f"{folder}/walked/{d}")
        part = records.in_rows(walked.select("sample_id", "triple_id"), "sample_id")
        on = part if on is None else on.unionByName(part)
    labels = own.select("sample_id", "triple_id").join(on.distinct().withColumn("_on", F.lit(1.0)), ["sample_id", "triple_id"], "left").select("sample_id", "triple_id", F.coalesce("_on", F.lit(0.0)).alias("label"))
    return labels, length


def directional_distances(triples: DataFrame, nodes: DataFrame, rounds: int = 2, reverse_rounds: int = 2) -> DataFrame:
    """nodes: sample_id, node, x0, x1 (topic one-hot). Adds f1.. and b1.. (pairs): means over in-edges (out-edges) of
    the last round's features; 0 where there are none. Repeated triples count as often as they occur.

    Both directions go in one pass: a triple sends its head's forward features to the tail and its tail's backward
    features to the head, and one aggregation takes both means. Each round is written, and all meet at their nodes, where
    they lie."""
    folder = records.scratch(triples.sparkSession)
    way = lambda a, b, forward: F.struct(F.col(a).alias("node"), F.col(b).alias("to"), F.lit(forward).alias("forward"))
    sent = triples.select("sample_id", F.explode(F.array(way("h", "t", True), way("t", "h", False))).alias("x")).select("sample_id", "x.*")
    sent = records.dealt(sent.groupBy("sample_id", "node", "to", "forward").agg(F.count("*").alias("n")), f"{folder}/edges")
    own = records.dealt(nodes.select("sample_id", "node", F.col("x0").cast("double").alias("f0"), F.col("x1").cast("double").alias("f1"), F.col("x0").cast("double").alias("b0"), F.col("x1").cast("double").alias("b1")).distinct(), f"{folder}/nodes")
    wide, last = own.select("sample_id", "node", F.col("f0").alias("x0"), F.col("f1").alias("x1")), own
    for i in range(1, max(rounds, reverse_rounds) + 1):
        message = sent.join(last, ["sample_id", "node"], "left")

        def mean(c: str) -> Column:
            here = F.col("forward") if c[0] == "f" else ~F.col("forward")
            return F.coalesce(F.sum(F.when(here, F.coalesce(F.col(c), F.lit(0.0)) * F.col("n"))) / F.sum(F.when(here, F.col("n"))), F.lit(0.0)).alias(c)

        last = records.dealt(message.groupBy("sample_id", F.col("to").alias("node")).agg(*map(mean, ("f0", "f1", "b0", "b1"))), f"{folder}/round{i}")
        new = last.select(F.col("sample_id").alias("_s"), F.col("node").alias("_n"), *(F.col(f"{c}{j}").alias(f"{c}{i}_{j}") for c in "fb" for j in (0, 1)))
        wide = wide.join(new, (F.col("sample_id") == F.col("_s")) & F.col("node").eqNullSafe(F.col("_n")), "left").drop("_s", "_n")
    names = [f"{c}{i}_{j}" for c, n in (("f", rounds), ("b", reverse_rounds)) for i in range(1, n + 1) for j in (0, 1)]
    return wide.select("sample_id", "node", "x0", "x1", *(F.coalesce(x, F.lit(0.0)).alias(x) for x in names)).where("x0 is not null")


def paths(triples: DataFrame, starts: DataFrame) -> DataFrame:
    """starts: sample_id, node. One- and two-hop paths from them: start, r1, mid, r2, target (r2 null for one hop)."""
    one = triples.join(starts.select("sample_id", F.col("node").alias("h")), ["sample_id", "h"]).select("sample_id", F.col("h").alias("start"), F.col("r").alias("r1"), F.col("t").alias("mid"))
    two = one.join(triples.select("sample_id", F.col("h").alias("mid"), F.col("r").alias("r2"), F.col("t").alias("target")), ["sample_id", "mid"])
    cols = ["sample_id", "start", "r1", "mid", "r2", "target"]
    return one.withColumn("r2", F.lit(None).cast("string")).withColumn("target", F.col("mid")).select(cols).unionByName(two.select(cols))
