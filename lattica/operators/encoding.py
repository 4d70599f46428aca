"""Dictionary encoding of per-question triple graphs.

Triples: sample_id, triple_id, h, r, t. Ids are dense within a sample: text entities in order, then the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Samples from which on a name is looked up once for all of them.
OFTEN = 1000


def ends(triples: DataFrame) -> DataFrame:
    """sample_id, entity: each name of a sample's triples once. Where triples are dealt by sample, no row moves."""
    return triples.select("sample_id", F.explode(F.array("h", "t")).alias("entity")).distinct()


def entities(triples: DataFrame, non_text: DataFrame, often: int = OFTEN) -> DataFrame:
    """sample_id, entity, entity_id, is_text. non_text: a table of identifiers, column entity. Names that many samples have
    would meet in one task, so they are looked up once each; a name costs its rows a share of 1 / often at most. Of the
    others, only identifiers go back to their samples."""
    every = ends(triples)
    listed = non_text.select("entity", F.lit(False).alias("_text")).distinct()
    many = every.groupBy("entity").agg(F.count("*").alias("_n")).where(F.col("_n") >= often).select("entity")
    many = F.broadcast(many.join(listed, "entity", "left").withColumn("_many", F.lit(True)))
    told = every.join(many, "entity", "left")
    few = told.where("_many is null").select("sample_id", "entity").join(listed, "entity").select("sample_id", "entity", F.col("_text").alias("_few"))
    marked = told.join(few, ["sample_id", "entity"], "left").withColumn("is_text", F.coalesce("_text", "_few", F.lit(True)))
    w = Window.partitionBy("sample_id").orderBy(F.col("is_text").desc(), "entity")
    return marked.select("sample_id", "entity", (F.row_number().over(w) - 1).alias("entity_id"), "is_text")


def relations(triples: DataFrame) -> DataFrame:
    w = Window.partitionBy("sample_id").orderBy("relation")
    return triples.select("sample_id", F.col("r").alias("relation")).distinct().select("sample_id", "relation", (F.row_number().over(w) - 1).alias("relation_id"))


def encoded(triples: DataFrame, entity: DataFrame, relation: DataFrame) -> DataFrame:
    """sample_id, triple_id, h_id, r_id, t_id; repeated triples stay."""
    e = entity.select("sample_id", "entity", "entity_id")
    out = triples.join(e.select("sample_id", F.col("entity").alias("h"), F.col("entity_id").alias("h_id")), ["sample_id", "h"])
    out = out.join(e.select("sample_id", F.col("entity").alias("t"), F.col("entity_id").alias("t_id")), ["sample_id", "t"])
    out = out.join(relation.select("sample_id", F.col("relation").alias("r"), F.col("relation_id").alias("r_id")), ["sample_id", "r"])
    return out.select("sample_id", "triple_id", "h_id", "r_id", "t_id")


def anchors_in_graph(anchors: DataFrame, entity: DataFrame) -> DataFrame:
    """anchors: sample_id, kind, entity. Those that the sample's graph has, with their ids."""
    return anchors.join(entity.select("sample_id", "entity", "entity_id"), ["sample_id", "entity"])
