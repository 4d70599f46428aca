"""Readers, writers and scratch tables."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: The session's setting for a folder that takes scratch tables instead of spark.checkpoint.dir, as runs set it.
SCRATCH_SETTING = "spark.lattica.scratch"


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a local session gets a temporary folder; on a cluster
    that is an error, as each machine would see a folder of its own."""
    top = spark.conf.get(SCRATCH_SETTING, None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="lattica-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/lattica-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(spark: SparkSession) -> None:
    """Joins on a sample and more keys take rows that are dealt by the sample alone as they lie, as windows and groups do.
    Stages whose generated methods HotSpot would never compile, as long text expressions make them, run operator by
    operator instead, whose methods are short."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


#: Rows of the inputs for each shuffle partition: what a task sorts then fits its memory, however large they are.
ROWS = 500_000


def roomy(spark: SparkSession, *inputs: DataFrame) -> None:
    """Raises the session's shuffle partitions, and with them the buckets of dealt tables, to one for each ROWS rows of the
    inputs. With a fixed number, tasks spill from some size of the input on. Counts read the files' footers only."""
    n = math.ceil(sum(df.count() for df in inputs) / ROWS)
    if n > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))


def by(df: DataFrame, key: str = "sample_id") -> DataFrame:
    """df dealt by key as dealt tables are: each bucket is one file then."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly: a small file is one split, which long expressions would leave to one task."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism))


def dealt(df: DataFrame, path: str, key: str = "sample_id", buckets: int | None = None) -> DataFrame:
    """written, in buckets by key, as many as shuffle partitions if not said: what then works sample by sample moves no row
    of the table again. The table's name is its own. A df that is dealt by key already isn't shuffled for it."""
    spark, name = df.sparkSession, f"lattica_{uuid.uuid4().hex}"
    together(spark)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("path", path).option("compression", "zstd").bucketBy(n, key).saveAsTable(name)
    return spark.table(name)


def bucketed(spark: SparkSession, path: str, key: str, buckets: int) -> DataFrame:
    """A table that dealt wrote, read from where it lies now, with its buckets."""
    name = f"lattica_{uuid.uuid4().hex}"
    together(spark)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    spark.sql(f"create table {name} ({columns}) using parquet clustered by (`{key}`) into {buckets} buckets location '{path}'")
    return spark.table(name)


def in_rows(df: DataFrame, column: str) -> DataFrame:
    """df with a filter that every row passes. Spark 4.1 takes a union of dealt tables for dealt, but where all of them are
    read in batches it lines their buckets up one after the other, so groups and joins of the union would miss rows. With
    a filter before the union it unites rows, bucket by bucket."""
    return df.where(F.col(column).isNull() | F.col(column).isNotNull())


class Levels:
    """A table dealt by key that grows by partitions d, as searches add levels to it."""

    def __init__(self, spark: SparkSession, path: str, key: str = "sample_id"):
        self.spark, self.path, self.key, self.name = spark, path, key, f"lattica_{uuid.uuid4().hex}"
        together(spark)

    def add(self, rows: DataFrame, d: int) -> DataFrame:
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions")) if d == 0 else self.n
        self.n = n
        rows.withColumn("d", F.lit(d)).write.mode("append").option("path", self.path).option("compression", "zstd").partitionBy("d").bucketBy(n, self.key).saveAsTable(self.name)
        return self.table().where(F.col("d") == d).drop("d")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that aren't valid JSON, and blank ones, are left out."""
    rows = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").schema(f"{schema}, _corrupt string").json(path)
    return rows.where("_corrupt is null").drop("_corrupt")


def last_by_id(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """The last row of each id wins."""
    w = Window.partitionBy(key).orderBy(F.desc(pos))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def not_done(rows: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Resume: rows that a former run hasn't written yet."""
    return rows.join(done.select(key), key, "left_anti")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A manifest or summary: CSV with a header, all texts."""
    return spark.read.option("header", True).csv(path)


def write_details(rows: DataFrame, path: str) -> None:
    """A JSON line for each row; nulls are written, so that all lines have the same fields."""
    rows.write.option("ignoreNullFields", False).json(path)


def computed_or_read(spark: SparkSession, path: str, compute) -> DataFrame:
    """The table at path; where there is none, compute() is written there first. Other errors of reading are raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:  # no such path, or one that a run left before its commit
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        compute().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)


def append_summary(rows: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Appends rows to a CSV table with a header. columns: what the table has, in order; what rows lack is empty, and what
    is not among them is left out."""
    own = rows if columns is None else rows.select(*(F.col(c).cast("string").alias(c) if c in rows.columns else F.lit("").alias(c) for c in columns))
    own.write.mode("append").option("header", True).csv(path)
