"""Scored triples: ranking, top-K, recall, filters, merging and perturbation.
Scored triples: sample_id, triple_id, h, r, t, score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.sources import records


def ranked(scored: DataFrame) -> DataFrame:
    """Adds rank from 1 within a sample, highest score first, ties by triple_id."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("sample_id").orderBy(F.desc("score"), "triple_id")))


def top_k(scored: DataFrame, k: int = 500) -> DataFrame:
    return ranked(scored).where(F.col("rank") <= k)


def score_map(scored: DataFrame) -> DataFrame:
    return scored.groupBy("sample_id", "h", "r", "t").agg(F.max("score").alias("score"))


def _recall(wanted: DataFrame, found: DataFrame, keys: list[str], ks: list[int]) -> DataFrame:
    """wanted: sample_id, keys, distinct. found: the same with rank, a row for each of them. k, recall, n_samples: the
    mean share of wanted rows among the first k, over samples of which something was found at all. What is wanted and not
    found counts as missed."""
    some = found.select("sample_id").distinct()
    rows = wanted.join(some, "sample_id", "left_semi").join(found, ["sample_id", *keys], "left")
    each = rows.groupBy("sample_id").agg(*(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))).alias(f"k{k}") for k in ks))
    wide = each.agg(*(F.avg(f"k{k}").alias(f"k{k}") for k in ks), F.count("*").alias("n"))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.round(f"k{k}", 6).alias("recall"), F.col("n").alias("n_samples")) for k in ks))).alias("x")).select("x.*")


def triple_recall(ranks: DataFrame, relevant: DataFrame, ks: list[int]) -> DataFrame:
    """ranks: scored triples with rank, of which a top-K is enough. relevant: sample_id, h, r, t, from shortest paths or
    from another source. k, recall, n_samples; equal triples are one."""
    triple = ["h", "r", "t"]
    found = ranks.groupBy("sample_id", *triple).agg(F.min("rank").alias("rank"))
    return _recall(relevant.select("sample_id", *triple).distinct(), found, triple, ks)


def answer_recall(ranks: DataFrame, answers: DataFrame, ks: list[int]) -> DataFrame:
    """answers: sample_id, entity (in the graph). Share of them among the ends of the first k: k, recall, n_samples."""
    found = ranks.select("sample_id", "rank", F.explode(F.array("h", "t")).alias("entity")).groupBy("sample_id", "entity").agg(F.min("rank").alias("rank"))
    return _recall(answers.select("sample_id", "entity").distinct(), found, ["entity"], ks)


def one_per_pair(ranks: DataFrame) -> DataFrame:
    """The first triple of each unordered pair of ends."""
    w = Window.partitionBy("sample_id", F.least("h", "t"), F.greatest("h", "t")).orderBy("rank")
    return ranks.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def without_answers(scored: DataFrame, answers: DataFrame) -> DataFrame:
    """Triples of which no end contains an answer of the sample."""
    each = answers.groupBy("sample_id").agg(F.collect_set("entity").alias("_a"))
    hit = F.exists("_a", lambda a: F.contains(F.col("h"), a) | F.contains(F.col("t"), a))
    return scored.join(each, "sample_id", "left").where(F.coalesce(~hit, F.lit(True))).drop("_a")


def with_gold(scored: DataFrame, gold: DataFrame) -> DataFrame:
    """Gold triples that were not retrieved come before all others, the last of them first."""
    missing = gold.join(scored.select("sample_id", "h", "r", "t"), ["sample_id", "h", "r", "t"], "left_anti")
    first = missing.select("sample_id", "h", "r", "t", (-F.col("triple_id") - 1).cast("long").alias("pos"))
    return first.unionByName(ranked(scored).select("sample_id", "h", "r", "t", F.col("rank").cast("long").alias("pos")))


def with_new(scored: DataFrame, new: DataFrame) -> DataFrame:
    """scored (sample_id, triple_id, h, r, t, score) and new triples (without triple_id), ranked together by falling
    score; of equal scores the old ones come first. sample_id, h, r, t, score, is_new, rank."""
    both = scored.select("sample_id", "h", "r", "t", "score", F.lit(False).alias("is_new"), "triple_id").unionByName(new.select("sample_id", "h", "r", "t", "score", F.lit(True).alias("is_new"), F.lit(0).alias("triple_id")))
    w = Window.partitionBy("sample_id").orderBy(F.desc("score"), "is_new", "triple_id", "h", "r", "t")
    return both.withColumn("rank", F.row_number().over(w)).drop("triple_id")


#: Draws for each triple wanted, before what is short is completed.
DRAWS = 4


def corrupted(graph: DataFrame, scored: DataFrame, questions: DataFrame, budget: int, seed: int = 0) -> DataFrame:
    """budget random triples for each sample, or all there are: of a triple of the graph that touches a question entity the
    other end (the tail, where both are such) becomes another entity of the graph. New triples are none of the graph's.
    Samples of which no triple touches one get none.

    graph: sample_id, h, r, t; questions: sample_id, entity. The product of such sources and entities is never listed.
    DRAWS * budget draws, by MD5 of seed, sample and number, take a source (numbered by h, r, t) and an entity (by name) each;
    what is no new triple, or was drawn, is rejected. Where they run short, members of the product follow in order, and
    only so many as must hold enough: at most two of them make the same triple, so 2 * budget and 2 for each triple of the
    graph and source. The score is the source's, or the sample's least where it isn't among scored.

    All joins are merged: Spark takes rows that draws explode to for as few as their samples, and small enough for the
    driver to broadcast; tables are dealt by sample, so that merging moves little."""
    triple = ["sample_id", "h", "r", "t"]
    merged = lambda df: df.hint("merge")
    own, q = graph.select(triple).distinct(), questions.select("sample_id", "entity").distinct()
    head, tail = (q.withColumnRenamed("entity", c).withColumn(f"_{c}", F.lit(True)) for c in ("h", "t"))
    source = own.join(merged(head), ["sample_id", "h"], "left").join(merged(tail), ["sample_id", "t"], "left").where("_h or _t").withColumn("_h", F.coalesce("_h", F.lit(False)))
    least = scored.groupBy("sample_id").agg(F.min("score").alias("_least"))
    numbered = lambda df, *by: df.withColumn("no", F.row_number().over(Window.partitionBy("sample_id").orderBy(*by)) - 1)
    priced = source.join(merged(score_map(scored)), triple, "left").join(merged(least), "sample_id", "left")
    sources = numbered(priced.select("sample_id", "h", "r", "t", "_h", F.coalesce("score", "_least", F.lit(0.0)).alias("score")), "h", "r", "t")
    pool = numbered(own.select("sample_id", F.explode(F.array("h", "t")).alias("entity")).distinct(), "entity")
    folder = records.scratch(graph.sparkSession)
    sources, pool = records.dealt(sources, f"{folder}/sources"), records.dealt(pool, f"{folder}/pool")
    sizes = sources.groupBy("sample_id").agg(F.count("*").alias("n_s")).join(merged(pool.groupBy("sample_id").agg(F.count("*").alias("n_e"))), "sample_id").join(merged(own.groupBy("sample_id").agg(F.count("*").alias("n_t"))), "sample_id")
    sizes = records.dealt(sizes, f"{folder}/sizes")

    def number(what: str, n: str):
        digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("sample_id").cast("string"), F.col("k").cast("string"), F.lit(what)))
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % F.col(n)

    def made(picks: DataFrame) -> DataFrame:
        """picks: sample_id, stage, k, s, e (numbers of source and entity)."""
        both = picks.join(merged(sources.withColumnRenamed("no", "s")), ["sample_id", "s"]).join(merged(pool.withColumnRenamed("no", "e")), ["sample_id", "e"])
        kept = F.when(F.col("_h"), F.col("h")).otherwise(F.col("t"))
        new = both.where(F.col("entity") != kept).select("sample_id", F.when(F.col("_h"), F.col("h")).otherwise(F.col("entity")).alias("h"), "r", F.when(F.col("_h"), F.col("entity")).otherwise(F.col("t")).alias("t"), F.struct("stage", "k", "score").alias("at"))
        return new.groupBy(triple).agg(F.min("at").alias("at")).join(merged(own), triple, "left_anti")

    drawn = sizes.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(DRAWS * budget - 1)))) if budget > 0 else sizes.withColumn("k", F.lit(0)).limit(0)
    first = records.dealt(made(drawn.select("sample_id", F.lit(0).alias("stage"), F.col("k").cast("long").alias("k"), number("source", "n_s").alias("s"), number("entity", "n_e").alias("e"))), f"{folder}/drawn")
    short = sizes.join(merged(first.groupBy("sample_id").agg(F.count("*").alias("n"))), "sample_id", "left").where(F.coalesce("n", F.lit(0)) < budget)
    most = F.least(F.col("n_s") * F.col("n_e"), 2 * budget + 2 * F.col("n_t") + 2 * F.col("n_s"))
    rest = short.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), most - 1)))
    rest = made(rest.select("sample_id", F.lit(1).alias("stage"), "k", F.floor(F.col("k") / F.col("n_e")).alias("s"), (F.col("k") % F.col("n_e")).alias("e")))
    every = first.unionByName(rest).groupBy(triple).agg(F.min("at").alias("at"))
    order = Window.partitionBy("sample_id").orderBy("at.stage", "at.k")
    return every.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= budget).select(*triple, "at.score")
