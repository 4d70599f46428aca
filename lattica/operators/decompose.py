"""Questions split into steps that depend on each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import questions, text
from lattica.sources import records

STEP = "struct<sub_id:int,question:string,dep_type:string>"


def _step(i: int, question: Column, dep_type: Column | str) -> Column:
    return F.struct(F.lit(i).alias("sub_id"), question.alias("question"), (F.lit(dep_type) if isinstance(dep_type, str) else dep_type).alias("dep_type"))


def steps(rows: DataFrame, most: int = 3) -> DataFrame:
    """rows: id, question. parent_id, id, sub_id, question, dep_prev_sub_id, dep_type, needs_prev_answer; up to `most`
    rows a question, none for an empty one. All of it is column expressions, one projection a step.

    A relative clause gives two steps. Otherwise the text is cut at conjunctions, and each further part becomes a
    follow-up of the one before; if one of them can't be asked on its own, the question stays whole. A cut at `before`
    or `after` alone never passes that test, so there is no branch for it."""
    own = records.spread(rows).select(F.col("id").cast("string").alias("parent_id"), text.strip(F.coalesce("question", F.lit(""))).alias("q")).where("q <> ''")
    whole = F.array(_step(0, questions.full(F.col("q")), "none"))
    halves = F.split("q", r"(?i)\b(?:that|which|who|whose)\b", 2)
    own = own.withColumn("left", questions._bare(F.get(halves, F.lit(0)), questions.EDGE)).withColumn("right", questions._bare(F.get(halves, F.lit(1)), questions.EDGE))
    own = own.withColumn("follow", questions.follow_up(F.col("right"), questions.focus(F.col("left")), "[B]"))
    clause = (F.col("left") != "") & (F.col("right") != "") & ~questions.says_little(F.col("left")) & (F.size(questions.words(F.col("left"))) >= 4) & (F.col("follow") != "") & ~questions.weak(F.col("follow"))
    own = own.withColumn("clause", clause)
    cut = F.col("q")
    for pattern in questions.SPLITS:
        cut = F.regexp_replace(cut, f"(?i){pattern}", " [SPLIT] ")
    parts = F.filter(F.transform(F.split(cut, r"\[SPLIT\]"), lambda x: questions._bare(x, questions.EDGE)), lambda x: F.length(x) > 3)
    own = own.withColumn("parts", parts).withColumn("parts", F.when(F.size("parts") == 0, F.array("q")).otherwise(F.slice("parts", 1, most)))
    own = own.withColumn("focus", F.lit("")).withColumn("made", F.array().cast(f"array<{STEP}>"))
    for i in range(most):
        own = own.withColumn("part", F.get("parts", F.lit(i)))
        repeated = F.exists(F.slice("parts", 1, i), lambda x: text.squeeze(x) == text.squeeze(F.col("part"))) if i else F.lit(False)
        if i == 0:
            asked = questions.full(F.col("part"))
            own = own.withColumn("asked", F.when(questions.says_little(asked), questions.about(F.col("part"), None)).otherwise(asked))
            kind = F.lit("none")
        else:
            slot = f"[{chr(ord('B') + i - 1)}]"
            own = own.withColumn("asked", questions.follow_up(F.col("part"), F.col("focus"), slot))
            own = own.withColumn("asked", F.when((F.col("asked") == "") | ~questions.refers(F.col("asked")), questions.about(F.col("part"), slot)).otherwise(F.col("asked")))
            own = own.withColumn("asked", questions.with_slot(F.col("asked"), slot))
            kind = questions.dependency(F.col("asked"))
        new = F.col("part").isNotNull() & ~repeated
        own = own.withColumn("made", F.when(new, F.concat("made", F.array(_step(i, questions.full(F.col("asked")), kind)))).otherwise(F.col("made")))
        own = own.withColumn("focus", F.when(new, F.coalesce(F.nullif(questions.focus(F.col("part")), F.lit("")), "focus")).otherwise(F.col("focus")))
    fails = F.exists("made", lambda x: (x["sub_id"] > 0) & questions.weak(x["question"]))
    two = F.slice(F.array(_step(0, questions.full(F.col("left")), "none"), _step(1, F.col("follow"), questions.dependency(F.col("follow")))), 1, most)
    chosen = F.when(~questions.many_hops(F.col("q")) | (fails & ~F.col("clause")), whole).when(F.col("clause"), two).otherwise(F.col("made"))
    out = own.select("parent_id", F.explode(chosen).alias("x")).select("parent_id", "x.*")
    later = F.col("sub_id") > 0
    name = F.when(later, F.concat_ws("_", "parent_id", F.col("sub_id").cast("string"))).otherwise(F.col("parent_id"))
    return out.select("parent_id", name.alias("id"), "sub_id", "question", F.when(later, F.col("sub_id") - 1).alias("dep_prev_sub_id"), "dep_type", later.alias("needs_prev_answer"))
