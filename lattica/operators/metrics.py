"""Answer quality and robustness metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import text


def answer_scores(rows: DataFrame) -> DataFrame:
    """rows: id, predictions, answers (arrays). Adds hit, precision, recall, f1: an answer counts for a prediction that
    contains it, a prediction for any answer that it contains. Many to many, so an upper bound of answers.one_to_one
    that needs no order of lines."""
    p, a = F.col("predictions"), F.col("answers")
    good = F.size(F.filter(p, lambda x: F.exists(a, lambda y: text.matches(x, y))))
    found = F.size(F.filter(a, lambda y: F.exists(p, lambda x: text.matches(x, y))))
    out = rows.withColumn("precision", F.coalesce(good / F.nullif(F.size(p), F.lit(0)), F.lit(0.0))).withColumn("recall", F.coalesce(found / F.nullif(F.size(a), F.lit(0)), F.lit(0.0)))
    both = F.col("precision") + F.col("recall")
    return out.withColumn("hit", (found > 0).cast("int")).withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(both, F.lit(0.0)), F.lit(0.0)))


def summary(scores: DataFrame) -> DataFrame:
    """Macro means in per cent, exact matches and totally wrong rows."""
    pct = lambda x: F.round(100 * F.avg(x), 6)
    return scores.agg(F.count("*").alias("n"), pct("hit").alias("hit"), pct("precision").alias("precision"), pct("recall").alias("recall"), pct("f1").alias("f1"), pct((F.col("f1") == 1).cast("int")).alias("exact"), pct((F.col("recall") == 0).cast("int")).alias("wrong"))


def attack_metrics(rows: DataFrame) -> DataFrame:
    """rows: id, predictions, targets. Over rows with a target that isn't blank: mean share of predictions that are
    targets, first-place hits and reciprocal rank, in per cent. Forms are plain; blank predictions don't count."""
    seen = lambda c: F.filter(c, lambda x: text.strip(x) != "")
    want = F.transform(seen("targets"), text.plain)
    hits = F.transform(seen("predictions"), lambda p: F.array_contains(want, text.plain(p)))
    n = F.size(hits)
    at = F.array_position(hits, F.lit(True))
    own = rows.where(F.size(seen("targets")) > 0)
    each = own.select(F.when(n > 0, F.size(F.filter(hits, lambda x: x)) / n).otherwise(0.0).alias("p"), F.coalesce(F.get(hits, F.lit(0)), F.lit(False)).cast("double").alias("h"), F.when(at > 0, 1 / at).otherwise(0.0).alias("m"))
    pct = lambda c: F.round(100 * F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return each.agg(F.count("*").alias("n"), pct("p").alias("a_precision"), pct("h").alias("a_hit1"), pct("m").alias("a_mrr"))


def attack_rates(predictions: DataFrame, targets: DataFrame) -> DataFrame:
    """predictions: id, prediction (a text); targets: id, targets. attack_metrics of the predictions that have targets: the
    answers that their texts make are held against them."""
    rows = predictions.select("id", text.made_answers(F.col("prediction")).alias("predictions")).join(targets.select("id", "targets"), "id")
    return attack_metrics(rows)


def _share(n, of):
    return F.round(F.coalesce(100 * n / F.nullif(of, F.lit(0)), F.lit(0.0)), 6)


def spread(steps: DataFrame) -> DataFrame:
    """steps: parent_id, question, hit, changed. shared_*: over questions, in plain form and not empty, that several parents
    ask: these parents, and the share that is hit there; a parent counts once for each question. overall_*: all
    parents, and the share of which a changed step is hit."""
    hit = F.coalesce("hit", F.lit(False))
    q = steps.withColumn("question", text.plain(F.col("question"))).where("question <> ''").groupBy("question").agg(F.count_distinct("parent_id").alias("n"), F.count_distinct(F.when(hit, F.col("parent_id"))).alias("h")).where("n > 1")
    shared = q.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("shared_parent_total"), F.coalesce(F.sum("h"), F.lit(0)).alias("_h"))
    each = steps.groupBy("parent_id").agg(F.max((hit & F.coalesce("changed", F.lit(False))).cast("int")).alias("any"))
    overall = each.agg(F.count("*").alias("overall_parent_total"), F.coalesce(F.sum("any"), F.lit(0)).alias("_any"))
    return shared.crossJoin(overall).select(_share(F.col("_h"), F.col("shared_parent_total")).alias("shared_parent_spread_rate"), _share(F.col("_any"), F.col("overall_parent_total")).alias("overall_parent_spread_rate"), "shared_parent_total", "overall_parent_total")


def _dependent(steps: DataFrame) -> DataFrame:
    """Steps that need an earlier answer, numbered from 1 within their parent."""
    own = steps.where("needs_prev_answer").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return own.withColumn("k", F.row_number().over(Window.partitionBy("parent_id").orderBy("sub_id")))


def dependency_rate(steps: DataFrame) -> DataFrame:
    """steps: parent_id, sub_id, needs_prev_answer, hit. Dependent steps, and the share that is hit."""
    return _dependent(steps).agg(F.count("*").alias("n"), _share(F.count_if("hit"), F.count("*")).alias("dependency_asr"))


def chain(steps: DataFrame) -> DataFrame:
    """By depth k: parents with so many dependent steps, those hit in all of the first k, and their share."""
    w = Window.partitionBy("parent_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    run = _dependent(steps).withColumn("all_hit", F.min(F.col("hit").cast("int")).over(w))
    return run.groupBy("k").agg(F.count("*").alias("chains"), F.sum("all_hit").alias("successes"), _share(F.sum("all_hit"), F.count("*")).alias("chain_success"))


def breakpoints(steps: DataFrame) -> DataFrame:
    """The first dependent step that isn't hit, by how many parents break there; none: also for those without any."""
    first = _dependent(steps).groupBy("parent_id").agg(F.min(F.when(~F.col("hit"), F.col("k"))).alias("k"))
    each = steps.select("parent_id").distinct().join(first, "parent_id", "left")
    return each.groupBy(F.coalesce(F.col("k").cast("string"), F.lit("none")).alias("breakpoint")).agg(F.count("*").alias("chains"))
