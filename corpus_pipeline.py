"""Corpus preparation in five stages. Each stage's rows are written as Parquet and read again as the next one's docs.

Stages take (spark, docs, sf_dir) and keep docs' columns; the last one returns token digests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import base, bpe, decontaminate, language_id, minhash, pii

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Words of a shingle and similarity for near-duplicates.
WORDS, SIMILARITY = 5, 0.8


def aside(docs: DataFrame) -> DataFrame:
    """Other columns under names that no operator uses, so that none can clash; toDF(*docs.columns) names them back."""
    return docs.toDF(*(c if c in ("doc_id", "text", "lang") else f"_column{i}" for i, c in enumerate(docs.columns)))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the classifier rejects go: null, without letters, or below the calibrated score. A null lang gets the
    prediction; others stay, as labels come from the source."""
    base.prepare(spark)
    own = aside(docs)
    found = language_id.identify(own, language_id.train(own), own.columns)
    return found.where(~F.col("rejected")).withColumn("lang", F.coalesce("lang", "lang_pred")).select(own.columns).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays, as do rows without id. Rows that repeat an id are one
    document here: all of them stay if one does, also where another one's text has a copy under a smaller id."""
    base.prepare(spark)
    kept = minhash.near_duplicates(docs.select("doc_id", "text"), WORDS, SIMILARITY).where("kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))


def decontaminate_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go; null texts have none."""
    own = aside(docs)
    found = decontaminate.contamination(own, base.table(spark, sf_dir, "benchmark"), keep=own.columns)
    return found.where(F.size("items") == 0).select(own.columns).toDF(*docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities become surrogates under the session's key (pii.KEY_SETTING); n_chars, where docs has it, follows. Null and
    clean texts stay as they are, and every row stays."""
    base.prepare(spark)
    own = aside(docs)
    out = pii.pseudonymized(own, pii.session_key(spark)).select(own.columns).toDF(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row of token digests for each row of docs; a null text has no tokens."""
    base.prepare(spark)
    return bpe.encode_documents(docs, bpe.default_path())


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_texts),
    ("pii", replace_personal_data),
    ("bpe", encode),
]
#: Models, keyed surrogates and tokens aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = base.table(spark, sf_dir, "documents"), base.scratch(spark)
    for i, (name, stage) in enumerate(STAGES):
        docs = base.written(stage(spark, docs, sf_dir), f"{folder}/{i}-{name}")
    return docs
