"""Evidence order and prompts.

Triples: sample_id, pos, h, r, t, score. marks: sample_id, kind, value, where kind is q (question entities), a
(answers), start or rule (start entities and relations of changed steps), target (texts that changes aim at; few a
sample). sets: sample_id, kind, pos, h, r, t, where kind is path (reasoning paths), support, front or injected."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import text
from lattica.operators import graph, retrieval
from lattica.sources import records

TRIPLE = ["h", "r", "t"]
#: Buckets, the first to be dropped from a prompt first.
BUCKETS = ("filler", "neighbor", "support", "skeleton", "attack")
#: What the name of a mode holds for each source of evidence, the first that it holds counts.
SOURCES = {"rog": "paths", "scored": "scored", "rand": "random", "noevi": "none"}


@dataclass(frozen=True)
class Mode:
    """What a prompt shows: its source, how many triples, the best ones last, the question first, no triples with an answer,
    one triple for each pair of ends, relevant triples that were not retrieved."""

    source: str
    n: int = 0
    reverse: bool = False
    question_first: bool = False
    no_answers: bool = False
    one_per_pair: bool = False
    relevant: bool = False


def mode_of(name: str) -> Mode:
    """scored_100, rog_50_rmht, scored_100_rev_firstq, randNoA_50, scored_100_gt, noevi: the source, then the number."""
    source = next((v for k, v in SOURCES.items() if k in name), None)
    if source is None:
        raise ValueError(f"no such mode: {name}")
    n = 0 if source == "none" else int(name.split("_")[1])
    return Mode(source, n, source == "scored" and "rev" in name, "firstq" in name, "randNoA" in name, source == "paths" and "rmht" in name, "gt" in name)


def _flagged(triples: DataFrame, marks: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds normal ends nh and nt and a flag for each kind of mark and set."""
    kinds = ("q", "a", "start")
    own = marks.withColumn("value", text.squeeze(F.col("value"))).where("value <> ''")
    ends = own.where(F.col("kind").isin(*kinds)).groupBy("sample_id", "value").agg(*(F.max((F.col("kind") == k).cast("int")).alias(k) for k in kinds))
    out = triples.withColumn("nh", text.squeeze(F.col("h"))).withColumn("nt", text.squeeze(F.col("t"))).withColumn("nr", text.squeeze(F.col("r")))
    for end in ("nh", "nt"):
        out = out.join(ends.select("sample_id", F.col("value").alias(end), *(F.col(k).alias(f"{end}_{k}") for k in kinds)), ["sample_id", end], "left")
    for k in kinds:
        out = out.withColumn(k, F.coalesce(F.greatest(f"nh_{k}", f"nt_{k}"), F.lit(0)))
    rules = own.where("kind = 'rule'").select("sample_id", F.col("value").alias("nr"), F.lit(1).alias("rule")).distinct()
    targets = own.where("kind = 'target'").groupBy("sample_id").agg(F.collect_set("value").alias("targets"))
    each = sets.groupBy("sample_id", *TRIPLE).agg(*(F.max((F.col("kind") == k).cast("int")).alias(k) for k in ("path", "support", "front", "injected")), F.min(F.when(F.col("kind") == "front", F.col("pos"))).alias("front_pos"))
    out = out.join(rules, ["sample_id", "nr"], "left").join(targets, "sample_id", "left").join(each, ["sample_id", *TRIPLE], "left")
    out = out.fillna(0, ["rule", "path", "support", "front", "injected"])
    aimed = F.coalesce(F.exists("targets", lambda x: F.contains(F.concat_ws(" ", "nh", "nr", "nt"), x)).cast("int"), F.lit(0))
    gold = F.col("rule") * F.col("start") * F.greatest("q", "a")
    return out.withColumn("aimed", aimed).withColumn("gold", gold).withColumn("seed", F.greatest("q", "start"))


def changed_first(flagged: DataFrame) -> DataFrame:
    """pos anew: front triples in their order, injected ones, those with a target's text, gold last, then by score."""
    w = Window.partitionBy("sample_id").orderBy(F.desc("front"), F.asc_nulls_last("front_pos"), F.desc("injected"), F.desc("aimed"), "gold", F.desc("score"), "pos")
    return flagged.withColumn("pos", F.row_number().over(w))


def ordered(triples: DataFrame, marks: DataFrame, sets: DataFrame, changed: bool = False) -> DataFrame:
    """sample_id, h, r, t, score, rank (from 1), priority (falling to 1), bucket; equal triples once.

    First the skeleton; then waves of triples that touch what was reached before, from the seeds and the skeleton's
    ends; then the rest. A wave is a distance, so it comes from one search over all samples. changed: front and injected
    triples order ties, and gold support goes, also where an injected triple has the form of it."""
    flagged = _flagged(triples, marks, sets)
    if changed:
        flagged = changed_first(flagged).where("gold = 0")
    own = records.dealt(flagged.drop("targets", *(f"{e}_{k}" for e in ("nh", "nt") for k in ("q", "a", "start"))), records.scratch(triples.sparkSession))
    core = "front + injected + support + gold + path + rule * greatest(start, q, a) > 0"
    rank_key = [F.desc("front"), F.desc("injected"), F.desc("gold"), F.desc(F.col("rule") * F.col("start")), F.desc("support"), F.desc("path"), F.desc("q"), F.desc("a"), F.desc("score"), "pos"]
    seeds = marks.where("kind in ('q', 'start')").select("sample_id", text.squeeze(F.col("value")).alias("node"))
    ends = own.where(core).select("sample_id", F.explode(F.array("nh", "nt")).alias("node"))
    step = own.select("sample_id", F.explode(F.array(F.struct(F.col("nh").alias("node"), F.col("nt").alias("to")), F.struct(F.col("nt").alias("node"), F.col("nh").alias("to")))).alias("x")).select("sample_id", "x.*").where("node <> ''").distinct()
    reach = graph.hops(step, seeds.unionByName(ends), ["sample_id"], both_ways=True)
    d = lambda end, name: reach.select("sample_id", F.col("node").alias(end), F.col("d").alias(name))
    far = own.join(d("nh", "dh"), ["sample_id", "nh"], "left").join(d("nt", "dt"), ["sample_id", "nt"], "left")
    near = F.least(F.when(F.col("nh") != "", F.col("dh")), F.when(F.col("nt") != "", F.col("dt")))
    new = F.greatest(F.coalesce("dh", near + 1), F.coalesce("dt", near + 1)) > near
    stage = F.when(F.expr(core), 0).when(near.isNotNull(), 1).otherwise(2)
    placed = far.withColumn("stage", stage).withColumn("wave", F.when(stage == 1, near + 1)).withColumn("new", F.when(stage == 1, new.cast("int")))
    in_wave = lambda c: F.desc(F.when(F.col("stage") == 1, F.col(c)))
    other = lambda c: F.desc(F.when(F.col("stage") != 1, c))
    keys = ["stage", "wave", in_wave("new"), in_wave("rule"), in_wave("seed"), other(F.col("front")), other(F.col("injected")), other(F.col("gold")), other(F.col("rule") * F.col("start")), other(F.col("support")), other(F.col("path")), *rank_key[6:]]
    first = placed.withColumn("_n", F.row_number().over(Window.partitionBy("sample_id", *TRIPLE).orderBy(*keys))).where("_n = 1")
    rank = F.row_number().over(Window.partitionBy("sample_id").orderBy(*keys))
    bucket = (
        F.when(F.expr("front + injected > 0"), "attack")
        .when(F.expr("gold + rule * greatest(start, q) > 0"), "skeleton")
        .when(F.expr("support + path > 0"), "support")
        .when(F.expr("greatest(seed, q, a) > 0"), "neighbor")
        .otherwise("filler")
    )
    out = first.withColumn("rank", rank).withColumn("bucket", bucket).withColumn("priority", F.count("*").over(Window.partitionBy("sample_id")) - F.col("rank") + 1)
    return out.select("sample_id", *TRIPLE, "score", "rank", "priority", "bucket")


def paths_first(paths: DataFrame, scored: DataFrame) -> DataFrame:
    """sample_id, rank, h, r, t: triples of reasoning paths, then the others, each once. Both: sample_id, pos, h, r, t."""
    both = paths.select("sample_id", F.lit(0).alias("stage"), "pos", *TRIPLE).unionByName(scored.select("sample_id", F.lit(1).alias("stage"), "pos", *TRIPLE))
    first = both.groupBy("sample_id", *TRIPLE).agg(F.min(F.struct("stage", "pos")).alias("at"))
    return first.select("sample_id", F.row_number().over(Window.partitionBy("sample_id").orderBy("at")).alias("rank"), *TRIPLE)


def shuffled(triples: DataFrame, seed: int = 0) -> DataFrame:
    """sample_id, rank, h, r, t: distinct triples in an order that the seed fixes."""
    w = Window.partitionBy("sample_id").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("sample_id").cast("string"), *TRIPLE)), *TRIPLE)
    return triples.select("sample_id", *TRIPLE).distinct().withColumn("rank", F.row_number().over(w))


def prompt_kind(mode: str, model: str = "", calls: str = "") -> str:
    """Which pair of texts a run uses, by what the names of its mode, model and way of calling say."""
    if "gpt" in model or "gpt" in mode:
        return "label" if "gptLabel" in mode else "examples"
    return "no_evidence" if "noevi" in mode else "examples" if "icl" in calls else "plain"


def with_evidence(rows: DataFrame, evidence: DataFrame, missing: str = "error") -> DataFrame:
    """rows and evidence: id; evidence also triples (an array of h, r, t, score) and others. Rows without evidence go
    (missing="drop"), get one empty triple ("placeholder", for runs of other systems) or are an error."""
    if missing == "drop":
        return rows.join(evidence, "id")
    out = rows.join(evidence.withColumn("_found", F.lit(True)), "id", "left")
    if missing == "placeholder":
        empty = F.array(F.struct(F.lit("").alias("h"), F.lit("").alias("r"), F.lit("").alias("t"), F.lit(0.0).alias("score")))
        return out.withColumn("triples", F.when(F.col("_found").isNull(), empty).otherwise(F.col("triples"))).drop("_found")
    lost = rows.join(evidence.select("id"), "id", "left_anti").select("id").first()
    if lost is not None:
        raise ValueError(f"no evidence for {lost.id}")
    return out.drop("_found")


def limited(rows: DataFrame, n: int) -> DataFrame:
    """The first n rows by pos; all where n is 0 or less."""
    return rows.orderBy("pos").limit(n) if n > 0 else rows


def relevant_first(evidence: DataFrame) -> DataFrame:
    """evidence: triples (h, r, t, score) and relevant (h, r, t). Relevant triples that triples don't hold come before them,
    the last one first, without a score."""
    same = lambda x, y: (x["h"] == y["h"]) & (x["r"] == y["r"]) & (x["t"] == y["t"])
    score = evidence.schema["triples"].dataType.elementType["score"].dataType
    lost = F.filter(F.coalesce("relevant", F.array()), lambda x: ~F.exists("triples", lambda y: same(x, y)))
    new = F.transform(F.reverse(lost), lambda x: F.struct(x["h"].alias("h"), x["r"].alias("r"), x["t"].alias("t"), F.lit(None).cast(score).alias("score")))
    return evidence.withColumn("triples", F.concat(new, "triples"))


def loaded(rows: DataFrame, graphs: DataFrame, evidence: DataFrame, known: DataFrame, mode: str = "", limit: int = 0) -> DataFrame:
    """Questions with their graphs, question entities and evidence, as a run in this mode starts from. rows: id, paths; pos
    with a limit. graphs: id, q_entity and others. evidence: id, scored_triples, or triples where another system made
    them. known: id, q_entity.

    A question without a graph, and without a limit a graph without a question, is an error. A question without
    evidence gets one empty triple where another system made it, goes in modes that add relevant triples (evidence
    then also has relevant), and is an error elsewhere."""
    own = limited(rows, limit)
    sides = [(own, graphs, "graph")] + ([] if limit > 0 else [(graphs, own, "question")])
    for left, right, what in sides:
        lost = left.select("id").join(right.select("id"), "id", "left_anti").first()
        if lost is not None:
            raise ValueError(f"no {what} for {lost.id}")
    others, relevant = "triples" in evidence.columns, mode != "" and mode_of(mode).relevant
    found = evidence if others else evidence.withColumnRenamed("scored_triples", "triples")
    found = relevant_first(found) if relevant else found
    return with_evidence(question_entities(own.join(graphs, "id"), known), found, "placeholder" if others else "drop" if relevant else "error")


def question_entities(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows: id, q_entity, paths (`node -> relation -> node` texts). known: id, q_entity. q_entity is that of known, else
    the row's, else the first node of the first path that has one; else empty."""
    nodes = F.filter(F.transform("paths", lambda p: F.substring_index(p, " -> ", 1)), lambda x: x != "")
    inferred = F.when(F.size("q_entity") > 0, F.col("q_entity")).otherwise(F.coalesce(F.slice(nodes, 1, 1), F.array().cast("array<string>")))
    return rows.join(known.select("id", F.col("q_entity").alias("_known")), "id", "left").withColumn("q_entity", F.coalesce("_known", inferred)).drop("_known")


def merged(triples: DataFrame, heads: bool = True) -> DataFrame:
    """Triples: sample_id, pos, h, r, t. Heads of the same relation and tail (or tails of the same head and relation)
    as one bracketed list, in order of first sight. The list is as long as the group within its sample."""
    keys, of = (["r", "t"], "h") if heads else (["h", "r"], "t")
    each = triples.groupBy("sample_id", *keys).agg(F.min("pos").alias("pos"), F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", of))), lambda x: x[of]), ","), F.lit("]")).alias(of))
    return each.select("sample_id", "pos", *TRIPLE)


def plan_block(steps: DataFrame) -> DataFrame:
    """steps: sample_id, sub_id, question, dep_prev_sub_id, dep_type, needs_prev_answer (three a sample at most). The
    plan's text for samples with more than one step."""
    depends = F.when(F.col("needs_prev_answer"), F.concat(F.lit("depends on step "), (F.col("dep_prev_sub_id") + 1).cast("string"))).otherwise("independent")
    line = F.format_string("[Step %d] %s (dependency: %s; type: %s)", F.col("sub_id") + 1, text.strip(F.col("question")), depends, F.coalesce("dep_type", F.lit("none")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("sub_id", line.alias("line")))), lambda x: x["line"])
    #: The lines around the steps.
    head = F.array(F.lit("Dependency-Aware Subquestions:"), F.lit("Solve the following subquestions in order before answering the original question."))
    tail = F.array(F.lit("Use the answer from each earlier step when a later step depends on it."))
    return steps.groupBy("sample_id").agg(F.count("*").alias("n"), lines.alias("lines")).where("n > 1").select("sample_id", F.array_join(F.concat(head, F.col("lines"), tail), "\n").alias("plan"))


def triplet_block(ranks: DataFrame, n: int, threshold: float | None = None, reverse: bool = False) -> DataFrame:
    """ranks: sample_id, rank, h, r, t (and score, priority, bucket, as far as known). The first n lines of each sample
    at or above the threshold: sample_id, lines (text, priority, bucket)."""
    own = ranks if threshold is None else ranks.where(F.col("score") >= threshold)
    known = set(own.columns)
    own = own.withColumn("_n", F.row_number().over(Window.partitionBy("sample_id").orderBy("rank"))).where(F.col("_n") <= n)
    priority = F.col("priority") if "priority" in known else F.lit(0)
    bucket = F.col("bucket") if "bucket" in known else F.lit("filler")
    line = F.struct(F.col("_n").alias("n"), text.triple_text(*(F.col(c) for c in TRIPLE)).alias("text"), priority.cast("long").alias("priority"), bucket.alias("bucket"))
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda x: F.struct(x["text"].alias("text"), x["priority"].alias("priority"), x["bucket"].alias("bucket")))
    return own.groupBy("sample_id").agg((F.reverse(lines) if reverse else lines).alias("lines"))


def rendered(questions: DataFrame, blocks: DataFrame | None, plans: DataFrame | None = None, system: str = "", question_first: bool = False) -> DataFrame:
    """questions: sample_id, question. Adds lines, user_query and all_query. blocks None: without evidence."""
    empty = F.array().cast("array<struct<text:string,priority:bigint,bucket:string>>")
    out = questions.withColumn("lines", empty) if blocks is None else questions.join(blocks, "sample_id", "left").withColumn("lines", F.coalesce("lines", empty))
    out = out.withColumn("plan", F.lit(None).cast("string")) if plans is None else out.join(plans, "sample_id", "left")
    asked = F.concat_ws("\n\n", "plan", F.concat(F.lit("Question:\n"), F.col("question")))
    asked = F.when(asked.endswith("?"), asked).otherwise(F.concat(asked, F.lit("?")))
    given = F.lit("") if blocks is None else F.concat(F.lit("Triplets:\n"), F.array_join(F.transform("lines", lambda x: x["text"]), "\n"))
    parts: list[Column] = [asked, given] if question_first else [given, asked]
    user = asked if blocks is None and not question_first else F.concat_ws("\n\n", *parts)
    return out.withColumn("user_query", user).withColumn("all_query", F.concat_ws("\n\n", F.lit(system), *parts)).drop("plan")


def lines_once(*parts: DataFrame) -> DataFrame:
    """Parts: sample_id, pos, h, r, t. sample_id, rank, h, r, t: all of the first part, then those of the next; of triples
    with the same line in a prompt the first. Triples are dealt by sample before they are grouped, and lines aren't moved."""
    cols = ["sample_id", F.col("pos").cast("long").alias("pos"), *TRIPLE]
    every = None
    for i, part in enumerate(parts):
        own = part.select(F.lit(i).alias("part"), *cols)
        every = own if every is None else every.unionByName(own)
    first = records.by(every).groupBy("sample_id", text.triple_text(*(F.col(c) for c in TRIPLE)).alias("line")).agg(F.min(F.struct("part", "pos", *TRIPLE)).alias("at"))
    rank = F.row_number().over(Window.partitionBy("sample_id").orderBy("at"))
    return first.withColumn("rank", rank).select("sample_id", "rank", *(F.col(f"at.{c}").alias(c) for c in TRIPLE))


def by_mode(
    mode: str, questions: DataFrame, scored: DataFrame | None = None, marks: DataFrame | None = None, sets: DataFrame | None = None, paths: DataFrame | None = None,
    triples: DataFrame | None = None, answers: DataFrame | None = None, plans: DataFrame | None = None, system: str = "", threshold: float | None = None, seed: int = 0, changed: bool = False,
) -> DataFrame:
    """rendered prompts for a mode by its name. questions: sample_id, question. The source names what is needed: scored
    triples with marks and sets (see ordered), the triples of reasoning paths before scored ones, all triples in an
    order that the seed fixes (with answers, sample_id and entity, where theirs go), or nothing. A threshold of 0 is none."""
    want = mode_of(mode)
    need = {"paths": {"paths": paths, "scored": scored}, "scored": {"scored": scored, "marks": marks, "sets": sets}, "random": {"triples": triples} | ({"answers": answers} if want.no_answers else {}), "none": {}}
    lacking = [k for k, v in need[want.source].items() if v is None]
    if lacking:
        raise ValueError(f"{mode} needs {', '.join(lacking)}")
    if want.source == "none":
        return rendered(questions, None, plans, system, want.question_first)
    if want.source == "scored":
        ranks = ordered(scored, marks, sets, changed)
    elif want.source == "random":
        dealt = shuffled(triples, seed)
        ranks = lines_once((retrieval.without_answers(dealt, answers) if want.no_answers else dealt).withColumnRenamed("rank", "pos"))
    else:
        once = lambda x: retrieval.one_per_pair(x.withColumnRenamed("pos", "rank")).withColumnRenamed("rank", "pos") if want.one_per_pair else x
        ranks = lines_once(once(paths), once(scored))
    block = triplet_block(ranks, want.n, (threshold or None) if want.source == "scored" else None, want.reverse)
    return rendered(questions, block, plans, system, want.question_first)


def labelled_evidence(rows: DataFrame, most: int = 20) -> DataFrame:
    """rows: id, user_query, prediction. Evidence that a prediction cites and its prompt holds, in either direction:
    id, cited, missing (counts) and evidence, which is empty if more than `most` triples are left."""
    shown = text.evidence_triples(F.filter(F.split(F.substring_index("user_query", "Question", 1), "\n"), lambda x: x != ""))
    cited = text.evidence_triples(text.evidence_lines(F.col("prediction")))
    good = lambda x: F.array_contains("_shown", x) | F.array_contains("_shown", F.struct(x["t"].alias("h"), x["r"].alias("r"), x["h"].alias("t")))
    out = rows.select("id", shown.alias("_shown"), cited.alias("_cited")).withColumn("_good", F.filter("_cited", good))
    kept = F.when(F.size("_good") > most, F.slice("_good", 1, 0)).otherwise(F.col("_good"))
    return out.select("id", F.size("_cited").alias("cited"), (F.size("_cited") - F.size("_good")).alias("missing"), kept.alias("evidence"))
