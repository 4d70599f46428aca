"""Samples for training and inference: anchors by position, rules for what is left out, and the join of samples with
labels. Samples: sample_id, question, q_entity, a_entity (arrays of names); triples as in encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import encoding


def anchor_ids(samples: DataFrame, entity: DataFrame, of: str) -> DataFrame:
    """sample_id, ids: of the names in column of, in their order and as often as they are named; names that the
    sample's graph lacks go. Every sample has a row."""
    each = samples.select("sample_id", F.posexplode(of).alias("pos", "entity")).join(entity.select("sample_id", "entity", "entity_id"), ["sample_id", "entity"])
    ids = each.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "entity_id"))), lambda x: x["entity_id"]).alias("ids"))
    return samples.select("sample_id").distinct().join(ids, "sample_id", "left").select("sample_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))


def processed(samples: DataFrame, triples: DataFrame, non_text: DataFrame) -> DataFrame:
    """Samples with q_ids, a_ids, n_text, n_other (entities by kind), n_relations and n_triples; of an empty graph too."""
    entity = encoding.entities(triples, non_text)
    kinds = entity.groupBy("sample_id").agg(F.count_if("is_text").alias("n_text"), F.count_if(~F.col("is_text")).alias("n_other"))
    sizes = triples.groupBy("sample_id").agg(F.count_distinct("r").alias("n_relations"), F.count("*").alias("n_triples"))
    ids = lambda of, name: anchor_ids(samples, entity, of).withColumnRenamed("ids", name)
    out = samples.join(ids("q_entity", "q_ids"), "sample_id").join(ids("a_entity", "a_ids"), "sample_id").join(kinds, "sample_id", "left").join(sizes, "sample_id", "left")
    return out.fillna(0, ["n_text", "n_other", "n_relations", "n_triples"])


def disagreeing(samples: DataFrame) -> DataFrame:
    """Samples whose a_entity isn't their answer, name by name: there should be none."""
    return samples.where(~F.col("a_entity").eqNullSafe(F.col("answer")))


def embeddable(rows: DataFrame, skip_no_topic: bool = True, skip_no_answer: bool = True) -> DataFrame:
    """Processed samples to embed: with a topic and an answer in the graph; a test split keeps all."""
    kept = rows.where(F.size("q_ids") > 0) if skip_no_topic else rows
    return kept.where(F.size("a_ids") > 0) if skip_no_answer else kept


def non_empty(rows: DataFrame) -> DataFrame:
    """Samples that have a triple to learn from or to score."""
    return rows.where("n_triples > 0")


def without_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Samples with triples that labels don't know: there should be none."""
    return non_empty(rows).join(labels.select("sample_id"), "sample_id", "left_anti")


def assembled(rows: DataFrame, labels: DataFrame, lengths: DataFrame, skip_no_path: bool = True) -> DataFrame:
    """Processed samples with max_path_length and n_relevant (labelled triples); answers once each. In training, samples
    without a path, or of length 0 only, go."""
    relevant = labels.groupBy("sample_id").agg(F.count_if(F.col("label") > 0).alias("n_relevant"))
    out = rows.join(lengths, "sample_id", "left").join(relevant, "sample_id", "left").fillna(0, ["n_relevant"])
    out = out.withColumn("a_entity", F.array_distinct("a_entity")).withColumn("a_ids", F.array_distinct("a_ids"))
    return out.where(F.coalesce("max_path_length", F.lit(0)) > 0) if skip_no_path else out


def relevance_statistics(rows: DataFrame, labels: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row over all samples, also those that assembled leaves out: n, n_skipped, and median, mean and maximum of
    relevant triples, cut to whole numbers."""
    every = assembled(rows, labels, lengths, skip_no_path=False)
    return every.agg(
        F.count("*").alias("n"), F.count_if(F.coalesce("max_path_length", F.lit(0)) == 0).alias("n_skipped"),
        F.median("n_relevant").cast("long").alias("median_relevant"), F.avg("n_relevant").cast("long").alias("mean_relevant"), F.max("n_relevant").alias("max_relevant"),
    )


def topics(entity: DataFrame, anchors: DataFrame) -> DataFrame:
    """entity: sample_id, entity. anchors: sample_id, entity. sample_id, node, x0, x1: one-hot, x1 for topic entities."""
    marked = entity.select("sample_id", "entity").join(anchors.select("sample_id", "entity", F.lit(1.0).alias("x1")).distinct(), ["sample_id", "entity"], "left")
    return marked.select("sample_id", F.col("entity").alias("node"), (1 - F.coalesce("x1", F.lit(0.0))).alias("x0"), F.coalesce("x1", F.lit(0.0)).alias("x1"))
