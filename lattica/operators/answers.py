"""Evaluation of answer texts. Rows: id, question, prediction (text), answers; further columns where named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import text


def _prepared(rows: DataFrame) -> DataFrame:
    """Adds _p (prediction lines with their normal forms), _a (answers by falling length), _two and no_answer."""
    first = F.transform(F.array_distinct("answers"), lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("a")))
    cut = F.transform(F.array_sort(first), lambda x, i: F.struct(i.alias("i"), text.normalize(text.year_only(F.col("question"), x["a"])).alias("norm")))
    lines = F.transform(
        text.answer_lines(F.col("prediction")),
        lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("p"), text.normalize(x).alias("norm"), text.normalize(text.after_mark(x)).alias("bare")),
    )
    return rows.withColumn("_p", lines).withColumn("_a", cut).withColumn("_two", text.two_way(F.col("question"))).withColumn("no_answer", text.without_answer(F.col("prediction")))


def _agree(p: Column, a: Column) -> Column:
    return F.contains(p["norm"], a["norm"]) | (F.col("_two") & (F.contains(a["norm"], p["bare"]) | F.contains(a["norm"], p["norm"])))


def _without(left: Column, hits: Column) -> Column:
    gone = F.get(hits, F.lit(0))["i"]
    return F.filter(left, lambda x: gone.isNull() | (x["i"] != gone))


def one_to_one(rows: DataFrame) -> DataFrame:
    """Adds n_predictions, n_answers, n_matched, precision, recall, f1, hit (of the first line) and no_answer. Answers,
    longest first, each use up the longest line that they match."""
    own = _prepared(rows)

    def step(acc: Column, a: Column) -> Column:
        hits = F.filter(acc["left"], lambda p: _agree(p, a))
        return F.struct(_without(acc["left"], hits).alias("left"), (acc["n"] + (F.size(hits) > 0).cast("int")).alias("n"))

    n = F.aggregate("_a", F.struct(F.array_sort("_p").alias("left"), F.lit(0).alias("n")), step, lambda acc: acc["n"])
    head = F.get(F.col("_p"), F.lit(0))
    hit = F.exists("_a", lambda a: F.contains(head["norm"], a["norm"]) | (F.col("_two") & F.contains(a["norm"], head["bare"])))
    out = own.withColumn("n_predictions", F.size("_p")).withColumn("n_answers", F.size("_a")).withColumn("n_matched", n).withColumn("hit", F.coalesce(hit, F.lit(False)).cast("int"))
    share = lambda of: F.coalesce(F.col("n_matched") / F.nullif(F.col(of), F.lit(0)), F.lit(0.0))
    p, r = F.col("precision"), F.col("recall")
    out = out.withColumn("precision", share("n_predictions")).withColumn("recall", share("n_answers"))
    return out.withColumn("f1", F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))).drop("_p", "_a", "_two")


def overview(scores: DataFrame) -> DataFrame:
    """Macro and micro means in per cent, exact and totally wrong shares, rows without answer. Of one_to_one's rows."""
    pct = lambda x: F.round(100 * F.coalesce(x, F.lit(0.0)), 6)
    ratio = lambda x, y: F.sum(x) / F.nullif(F.sum(y), F.lit(0))
    f = 2 * F.sum("n_matched") / F.nullif(F.sum("n_predictions") + F.sum("n_answers"), F.lit(0))
    return scores.agg(
        F.count("*").alias("n"),
        *(pct(F.avg(c)).alias(c) for c in ("hit", "f1", "precision", "recall")),
        pct(F.avg((F.col("f1") == 1).cast("int"))).alias("exact"),
        pct(F.avg((F.col("recall") == 0).cast("int"))).alias("wrong"),
        pct(ratio("n_matched", "n_predictions")).alias("micro_precision"),
        pct(ratio("n_matched", "n_answers")).alias("micro_recall"),
        pct(f).alias("micro_f1"),
        F.count_if("no_answer").alias("no_answer"),
    )


def evaluated(rows: DataFrame, samples: DataFrame, hops: int = -1, part: str = "all") -> DataFrame:
    """The rows (id) that an evaluation counts. samples: id, max_path_length, a_entity_in_graph. hops: 1 or 2 exactly, 3
    for three or more, 0 and less for any; part: all, good (the graph has an answer) or bad (it has none)."""
    length, size = F.coalesce("max_path_length", F.lit(-1)), F.greatest(F.size("a_entity_in_graph"), F.lit(0))
    own = samples if hops <= 0 else samples.where(length >= 3 if hops == 3 else length == hops)
    own = own if part == "all" else own.where(size > 0 if part == "good" else size == 0)
    return rows.join(own.select("id"), "id", "left_semi")


def report(rows: DataFrame) -> DataFrame:
    """One row: both evaluations of the same predictions (rows as in hallucination), in per cent."""
    pct = lambda c: F.round(100 * F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(f"original_{c}")
    return overview(one_to_one(rows)).crossJoin(original(rows).agg(*map(pct, ("hit", "accuracy", "precision", "recall", "f1")))).crossJoin(hallucination_overview(hallucination(rows)).select(F.col("score").alias("hallucination_score")))


COUNTERS = ("correct_in_graph", "correct_out_graph", "wrong_in_graph", "wrong_out_graph")


def hallucination(rows: DataFrame) -> DataFrame:
    """rows also: answerable (the graph has an answer), evidence (entities of the retrieved triples). Adds score, the
    four COUNTERS of lines and no_answer.

    Answerable: 0 without an answer, else the mean of +1 for a line that uses up an answer and -1 for another one. Not
    answerable: 1 without an answer, else the mean of -1 for a line that the evidence has, -1.5 for another one."""
    own = _prepared(rows).withColumn("_e", F.transform("evidence", F.lower))

    def step(acc: Column, p: Column) -> Column:
        bare = text.after_mark(F.lower(p["p"]))
        seen = F.exists("_e", lambda e: F.contains(e, bare) | F.contains(F.lower(p["p"]), e))
        uses = F.col("answerable") | ~seen
        hits = F.filter(acc["left"], lambda a: uses & _agree(p, a))
        right = F.size(hits) > 0
        add = lambda name, when: (acc[name] + when.cast("int")).alias(name)
        return F.struct(_without(acc["left"], hits).alias("left"), add("correct_in_graph", right & seen), add("correct_out_graph", right & ~seen), add("wrong_in_graph", ~right & seen), add("wrong_out_graph", ~right & ~seen))

    zero = F.struct(F.col("_a").alias("left"), *(F.lit(0).alias(c) for c in COUNTERS))
    lines = F.when(F.col("no_answer"), F.slice("_p", 1, 0)).otherwise(F.col("_p"))
    out = own.withColumn("_c", F.aggregate(lines, zero, step)).select("*", *(F.col("_c")[c].alias(c) for c in COUNTERS))
    right, wrong = F.col("correct_in_graph") + F.col("correct_out_graph"), F.col("wrong_in_graph") + F.col("wrong_out_graph")
    good = F.when(F.col("no_answer"), 0.0).otherwise((right - wrong) / F.size("_p"))
    seen, unseen = F.col("correct_in_graph") + F.col("wrong_in_graph"), F.col("correct_out_graph") + F.col("wrong_out_graph")
    bad = F.when(F.col("no_answer"), 1.0).otherwise((-seen - 1.5 * unseen) / F.size("_p"))
    return out.withColumn("score", F.when(F.col("answerable"), good).otherwise(bad)).drop("_p", "_a", "_two", "_e", "_c")


def hallucination_overview(scores: DataFrame) -> DataFrame:
    """The mean score, scaled from [-1.5, 1] to [0, 100], and counters for answerable rows and others."""
    mean = F.round((F.avg("score") + 1.5) / 2.5 * 100, 6).alias("score")
    of = lambda kind, flag: [F.count_if(flag).alias(f"{kind}_rows"), F.count_if(flag & F.col("no_answer")).alias(f"{kind}_no_answer"), *(F.sum(F.when(flag, F.col(c)).otherwise(0)).alias(f"{kind}_{c}") for c in COUNTERS)]
    return scores.agg(F.count("*").alias("n"), mean, *of("good", F.col("answerable")), *of("bad", ~F.col("answerable")))


def original(rows: DataFrame) -> DataFrame:
    """The older scores: hit of any line (without `ans:` of the whole text; an empty line is part of any answer), accuracy of the text, and precision, recall
    and f1 where only a line that is part of an answer is used up and all lines are counted."""
    own = _prepared(rows).withColumn("_t", text.normalize(F.coalesce("prediction", F.lit("")))).withColumn("_l", F.split(F.coalesce("prediction", F.lit("")), "\n"))
    lines = F.exists("_a", lambda a: F.exists("_p", lambda p: F.contains(p["norm"], a["norm"]) | (F.col("_two") & F.contains(a["norm"], p["bare"]))))
    plain = F.exists("_a", lambda a: F.contains(F.col("_t"), a["norm"]) | (F.col("_two") & F.exists("_l", lambda x: F.contains(a["norm"], text.normalize(x)))))

    def step(acc: Column, a: Column) -> Column:
        whole = F.contains(F.col("_t"), a["norm"])
        hits = F.filter(acc["left"], lambda p: ~whole & F.col("_two") & F.contains(a["norm"], p["bare"]))
        return F.struct(_without(acc["left"], hits).alias("left"), (acc["n"] + (whole | (F.size(hits) > 0)).cast("int")).alias("n"))

    n = F.aggregate("_a", F.struct(F.col("_p").alias("left"), F.lit(0).alias("n")), step, lambda acc: acc["n"])
    accuracy = F.size(F.filter("_a", lambda a: F.contains(F.col("_t"), a["norm"]))) / F.nullif(F.size("_a"), F.lit(0))
    out = own.withColumn("hit", F.when(F.contains("prediction", F.lit("ans:")), lines).otherwise(plain).cast("int")).withColumn("accuracy", F.coalesce(accuracy, F.lit(0.0)))
    p, r = F.col("precision"), F.col("recall")
    empty = F.coalesce(F.length("prediction"), F.lit(0)) == 0
    share = lambda of: F.when(empty, 0.0).otherwise(F.coalesce(n / F.nullif(of, F.lit(0)), F.lit(0.0)))
    out = out.withColumn("precision", share(F.size("_l"))).withColumn("recall", share(F.size("_a")))
    return out.withColumn("f1", F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))).drop("_p", "_a", "_two", "_t", "_l")


def votes(rows: DataFrame, k: int = -1) -> DataFrame:
    """rows: id, pos, prediction. Predictions of an id by how often they occur, first seen first; the first k, or all."""
    each = rows.groupBy("id", "prediction").agg(F.count("*").alias("n"), F.min("pos").alias("_first"))
    out = each.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "_first"))).drop("_first")
    return out if k < 0 else out.where(F.col("rank") <= k)


def stage_metrics(rows: DataFrame) -> DataFrame:
    """rows: id, prompt, prediction, injected (array of h, r, t), targets. Of rows with targets: how many prompts hold an
    injected triple; of these, how many predictions a target; of rows with such a prediction, the share of them."""
    flat = lambda x: F.regexp_replace(x, r"\s+", "")
    want = F.filter(F.transform("targets", text.plain), lambda x: x != "")
    made = F.transform(text.loose_answers(F.col("prediction")), text.plain)
    each = rows.where(F.size("targets") > 0).select(
        F.exists("injected", lambda t: F.contains(flat(F.col("prompt")), flat(text.triple_text(t["h"], t["r"], t["t"])))).alias("retrieved"),
        F.size(made).alias("n"),
        F.size(F.filter(made, lambda p: F.exists(want, lambda t: F.contains(p, t)))).alias("hits"),
    )
    hit = F.col("hits") > 0
    pct = lambda x: F.round(100 * F.coalesce(F.avg(x), F.lit(0.0)), 6)
    return each.agg(
        F.count("*").alias("n"),
        F.count_if("retrieved").alias("n_retrieved"),
        F.count_if(hit).alias("n_generated"),
        pct(F.col("retrieved").cast("int")).alias("retrieval_rate"),
        pct(F.when(F.col("retrieved"), hit.cast("int"))).alias("generation_rate"),
        pct(F.when(hit, F.col("hits") / F.col("n"))).alias("precision"),
    )


def stage_breakdown(details: DataFrame) -> DataFrame:
    """details, a row for each question: steps, first_changed, first_hit, second_depends, second_hit,
    second_mentions_first, final_hit, final_rr. The number of all questions; of those with two or more steps: how many,
    how many have a changed first or a dependent second step, rates, conditional rates, and the stage at which a change
    is lost."""
    many = F.col("steps") >= 2
    lost = (
        F.when(F.col("first_changed") & ~F.col("first_hit"), "first")
        .when(F.col("second_depends") & ~F.col("second_hit"), "second")
        .when(F.col("second_hit") & ~F.col("final_hit"), "final")
        .when(F.col("final_hit"), "none")
    )
    changed, depends = many & F.col("first_changed"), many & F.col("second_depends")
    first, second = changed & F.col("first_hit"), depends & F.col("second_hit")
    pct = lambda of, x: F.round(100 * F.coalesce(F.avg(F.when(of, x.cast("double"))), F.lit(0.0)), 6)
    return details.agg(
        F.count("*").alias("total"),
        F.count_if(many).alias("n"),
        F.count_if(changed).alias("n_first_changed"),
        F.count_if(depends).alias("n_second_depends"),
        pct(changed, F.col("first_hit")).alias("first_rate"),
        pct(depends, F.col("second_hit")).alias("second_rate"),
        pct(first, F.col("second_hit")).alias("second_given_first"),
        pct(depends, F.col("second_mentions_first")).alias("mention_rate"),
        pct(first, F.col("second_mentions_first")).alias("mention_given_first"),
        pct(many, F.col("final_hit")).alias("final_rate"),
        pct(first, F.col("final_hit")).alias("final_given_first"),
        pct(second, F.col("final_hit")).alias("final_given_second"),
        pct(many, F.col("final_rr")).alias("final_mrr"),
        pct(first, F.col("final_rr")).alias("final_mrr_given_first"),
        *(F.count_if(many & (lost == x)).alias(f"lost_{x}") for x in ("first", "second", "final", "none")),
    )
