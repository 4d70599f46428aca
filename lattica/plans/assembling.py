"""Queries of sample assembly, targets and evaluation filters over the star-schema tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import answers, assembly, encoding, graph, metrics, prompts, retrieval, targets
from lattica.plans import answering, catalogue
from lattica.plans.catalogue import homes, table
from lattica.sources import records


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names repeat and some aren't in the graph; every fourth question's entity isn't, every third one's answers aren't."""
    i = F.col("sample_id")
    q = F.when(i % 4 == 0, F.array(F.lit("nowhere"))).otherwise(F.array(F.col("c_name"), F.lit("nowhere"), F.col("c_name")))
    a = F.when(i % 3 == 0, F.array(F.lit("Atlantis"))).otherwise(F.array("r_name", F.lit("Atlantis"), F.col("n_name"), F.col("r_name")))
    return homes(spark, sf_dir).select("sample_id", F.lit("where?").alias("question"), q.alias("q_entity"), a.alias("a_entity"), a.alias("answer"))


def _text(df: DataFrame) -> DataFrame:
    return df.select(*(F.concat_ws(",", F.transform(f.name, lambda x: x.cast("string"))).alias(f.name) if f.dataType.typeName() == "array" else f.name for f in df.schema.fields))


def _parts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Processed samples, labels and lengths; customers with an order without items have no pair to search for."""
    t = catalogue.saved(s, d)
    asked = catalogue.pairs(s, d).join(catalogue.waiting(s, d), "sample_id", "left_anti")
    labels, lengths = graph.shortest_path_labels(t, records.dealt(asked, records.scratch(s)))
    return assembly.processed(samples(s, d), t, catalogue.non_text(s, d)), labels, lengths


def _assembled(s, d):
    out = assembly.assembled(*_parts(s, d))
    return _text(out.select("sample_id", "q_ids", "a_ids", "n_text", "n_other", "n_relations", "n_triples", "max_path_length", "n_relevant"))


def _topics(s, d):
    t = catalogue.saved(s, d)
    return assembly.topics(encoding.entities(t, catalogue.non_text(s, d)), samples(s, d).select("sample_id", F.explode("q_entity").alias("entity")))


def _with_new(s, d):
    t = catalogue.saved(s, d)
    top = retrieval.top_k(t, 3).drop("rank")
    return retrieval.with_new(top, retrieval.corrupted(t, top, homes(s, d).select("sample_id", F.col("c_name").alias("entity")), 2))


def no():
    return F.array().cast("array<string>")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step for each event; users are questions. Each KEY is known for some steps only."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    one = lambda *xs: F.array(*xs)
    keys = [
        F.when(i % 4 == 0, one(F.upper("event_type"), F.lit(" "))).otherwise(no()), F.when(i % 4 == 1, one(F.concat("event_type", F.lit("!")))).otherwise(no()),
        F.when(i % 8 < 2, one(F.lit("été"))), F.when(i % 4 == 2, F.lit("été-"))
    ]
    cols = [i.alias("sub_id"), F.col("event_type").alias("question"), (i % 2 == 0).alias("changed"), (i % 3 > 0).alias("needs_prev_answer"), *(k.alias(n) for k, n in zip(keys, (*targets.KEYS, targets.SINGLE), strict=True))]
    return e.select(F.col("user_id").alias("id"), *cols)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with two steps each, as their own or, for every third one, from a table; traces name the steps 0 and 1."""
    i = F.col("sample_id")
    step = lambda n, q, changed, needs, own: F.struct(F.lit(n).cast("long").alias("sub_id"), q.alias("question"), changed.alias("changed"), needs.alias("needs_prev_answer"), own.alias("attack_targets"), F.array(F.lit("Atlantis")).alias("cascade_poison_targets"), no().alias("poison_targets"), F.lit(None).cast("string").alias("poison_target"))
    two = F.array(step(1, F.lit("then?"), i % 4 == 0, i % 2 == 0, no()), step(0, F.lit("where?"), i % 3 > 0, F.lit(False), F.when(i % 5 == 0, no()).otherwise(F.array("n_name"))))
    trace = F.array(F.struct(F.when(i % 2 == 0, 0).cast("long").alias("sub_id"), F.concat(F.lit("Ans: "), "n_name", F.lit("!\nans:")).alias("prediction")), F.struct(F.lit(1).cast("long").alias("sub_id"), F.when(i % 7 == 0, F.concat(F.lit("ans: none\nans: atlantis, i think of "), "n_name")).otherwise(F.concat(F.lit("ans: "), "r_name")).alias("prediction")))
    said = F.when(i % 11 == 0, "").otherwise(F.concat(F.lit("ans: "), "r_name", F.lit("\nans: ATLANTIS")))
    return homes(spark, sf_dir).select(
        i.alias("id"), said.alias("prediction"), trace.alias("trace"), two.alias("steps"), no().alias("attack_targets"), no().alias("cascade_poison_targets"),
        F.when(i % 4 == 1, F.array("r_name")).otherwise(no()).alias("poison_targets"), F.lit(None).cast("string").alias("poison_target"),
    )


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """questions, of which every third one's steps come from a table."""
    q = questions(spark, sf_dir)
    own = q.withColumn("steps", F.when(F.col("id") % 3 == 0, F.slice("steps", 1, 0)).otherwise(F.col("steps")))
    return targets.with_steps(own, q.select("id", F.explode("steps").alias("step")))


def _meta(s, d):
    e = steps(s, d).withColumn("injected", F.array(F.struct(F.col("question").alias("h"), F.lit("r").alias("r"), F.col("sub_id").cast("string").alias("t"))))
    meta = targets.last_meta(e, "sub_id")
    asked = homes(s, d).select(F.col("sample_id").alias("id"), F.when(F.col("sample_id") % 2 == 0, F.array("n_name")).otherwise(no()).alias("attack_targets"), no().alias("cascade_poison_targets"), F.when(F.col("sample_id") % 3 == 0, F.array(F.lit(" "))).otherwise(no()).alias("poison_targets"), F.lit("only a single one").alias("poison_target"), F.slice(F.array(F.struct(F.lit("h").alias("h"), F.lit("r").alias("r"), F.lit("t").alias("t"))), F.lit(1), (F.col("sample_id") % 2).cast("int")).alias("injected"))
    out = targets.with_meta(asked.withColumn("front", F.col("injected")).withColumn("injected", F.slice("injected", 1, 0)), meta, ("injected", "front"))
    return out.select("id", F.concat_ws("|", "targets").alias("targets"), F.coalesce(F.get("injected", F.lit(0))["t"], F.lit("-")).alias("injected"))


def _evaluated(s, d):
    """How many rows each filter counts."""
    i = F.col("sample_id")
    own = homes(s, d).select(i.alias("id"), F.when(i % 5 > 0, (i % 5).cast("int")).alias("max_path_length"), F.slice(F.array("n_name"), F.lit(1), (i % 2).cast("int")).alias("a_entity_in_graph"))
    rows, out = own.select("id"), None
    for hops in (-1, 1, 2, 3):
        for part in ("all", "good", "bad"):
            n = answers.evaluated(rows, own, hops, part).agg(F.count("*").alias("n")).select(F.lit(hops).alias("hops"), F.lit(part).alias("part"), "n")
            out = n if out is None else out.unionByName(n)
    return out


def _evidence(s, d):
    some = homes(s, d).join(catalogue.waiting(s, d), "sample_id", "left_anti").select(F.col("sample_id").alias("id"), F.array(F.struct(F.col("c_name").alias("h"), F.lit("r").alias("r"), F.col("n_name").alias("t"), F.lit(0.5).alias("score"))).alias("triples"))
    rows = homes(s, d).select(F.col("sample_id").alias("id"))
    both = prompts.with_evidence(rows, some, "drop").withColumn("way", F.lit("drop")).unionByName(prompts.with_evidence(rows, some, "placeholder").withColumn("way", F.lit("placeholder")))
    return both.select("id", "way", F.get("triples", F.lit(0))["t"].alias("t"))


def _question_entities(s, d):
    i = F.col("sample_id")
    rows = homes(s, d).select(i.alias("id"), F.when(i % 3 == 0, F.array("n_name")).otherwise(no()).alias("q_entity"), F.when(i % 5 == 0, no()).otherwise(F.array(F.lit(" -> lost"), F.concat("c_name", F.lit(" -> location.nation -> "), "n_name"), F.col("r_name"))).alias("paths"))
    known = homes(s, d).where("sample_id % 4 = 0").select(i.alias("id"), F.array("r_name").alias("q_entity"))
    return prompts.question_entities(rows, known).select("id", F.concat_ws("|", "q_entity").alias("q_entity"))


QUERIES = {
    "as_assembled": _assembled,
    "as_statistics": lambda s, d: assembly.relevance_statistics(*_parts(s, d)),
    "as_embeddable": lambda s, d: assembly.embeddable(assembly.processed(samples(s, d), catalogue.saved(s, d), catalogue.non_text(s, d))).select("sample_id", F.concat_ws(",", F.transform("a_ids", lambda x: x.cast("string"))).alias("a_ids")),
    "as_topics": _topics,
    "kg_with_new": _with_new,
    "tg_target_sets": lambda s, d: _text(targets.target_sets(steps(s, d))),
    "tg_with_meta": _meta,
    "tg_cascades": lambda s, d: targets.cascades(staged(s, d)).withColumn("final_rr", F.round("final_rr", 6)),
    "tg_steps": lambda s, d: targets.traced_steps(staged(s, d)),
    "tg_spread": lambda s, d: metrics.spread(targets.traced_steps(staged(s, d))),
    "tg_breakdown": lambda s, d: answers.stage_breakdown(targets.cascades(staged(s, d))),
    "qa_evaluated": _evaluated,
    "qa_report": lambda s, d: answers.report(answering.rows(s, d)).select("n", "hit", "f1", "original_hit", "original_accuracy", "hallucination_score"),
    "pr_with_evidence": _evidence,
    "pr_question_entities": _question_entities,
}

NAMED = """named as (select *, case when sample_id % 4 = 0 then ['nowhere'] else [c_name, 'nowhere', c_name] end q, case when sample_id % 3 = 0 then ['Atlantis'] else [r_name, 'Atlantis', n_name, r_name] end a from home),
qi as (select sample_id, string_agg(entity_id::varchar, ',' order by i) q_ids from (select sample_id, unnest(q) entity, generate_subscripts(q, 1) i from named) join ids using (sample_id, entity) group by 1),
ai as (select sample_id, string_agg(entity_id::varchar, ',' order by i) a_all, string_agg(entity_id::varchar, ',' order by i) filter (i < 4) a_ids from (select sample_id, unnest(a) entity, generate_subscripts(a, 1) i from named) join ids using (sample_id, entity) group by 1),
es as (select sample_id, count(*) filter (is_text) n_text, count(*) filter (not is_text) n_other from ids group by 1),
ts as (select sample_id, count(distinct r) n_relations, count(*) n_triples from triples group by 1)"""
#: One short step is the first, as steps are ordered by number; its own targets are null for every fifth question.
CASCADES = f"""with {catalogue.HOME},
c as (select sample_id id, sample_id % 3 > 0 first_changed, sample_id % 5 > 0 as first_hit, sample_id % 2 = 0 second_depends, sample_id % 7 = 0 second_hit, case when sample_id % 11 = 0 then 0 when sample_id % 4 = 1 then 1 else 0.5 end final_rr from home)"""
ORACLES = {
    "as_assembled": catalogue._sql("select sample_id, coalesce(q_ids, '') as q_ids, coalesce(a_ids, '') as a_ids, n_text, n_other, n_relations, n_triples, 2 as max_path_length, 2::bigint as n_relevant from home left join qi using (sample_id) left join ai using (sample_id) join es using (sample_id) join ts using (sample_id) where sample_id not in " + catalogue.WAITING, NAMED),
    "as_statistics": catalogue._sql(f"select count(*) as n, count(*) filter (sample_id in {catalogue.WAITING}) as n_skipped, floor(median(x))::bigint as median_relevant, floor(avg(x))::bigint as mean_relevant, max(x)::bigint as max_relevant from (select sample_id, case when sample_id in {catalogue.WAITING} then 0 else 2 end x from home)"),
    "as_embeddable": catalogue._sql("select sample_id, a_all as a_ids from qi join ai using (sample_id)", NAMED),
    "as_topics": catalogue._sql("select e.sample_id, e.entity as node, case when e.entity = c_name and e.sample_id % 4 <> 0 then 0.0 else 1.0 end::double as x0, case when e.entity = c_name and e.sample_id % 4 <> 0 then 1.0 else 0.0 end::double as x1 from ends e join home using (sample_id)"),
    "kg_with_new": catalogue._sql("select sample_id, h, r, t, score, is_new, (row_number() over (partition by sample_id order by score desc, is_new, triple_id, h, r, t))::int as rank from (select sample_id, h, r, t, score, false is_new, triple_id from ranked where rank <= 3 union all select sample_id, h, r, t, score, true, 0 from made)", catalogue.corrupted_sql(2)),
    "tg_target_sets": "select user_id as id, string_agg(distinct target, ',' order by target) as targets from (select user_id, case event_id % 4 when 2 then 'été' else case when event_id % 4 = 3 then null else replace(lower(event_type), '_', ' ') end end target from events) where target is not null group by 1",
    "tg_with_meta": f"with {catalogue.HOME}, m as (select user_id id, arg_max(case event_id % 4 when 0 then replace(lower(event_type), '_', ' ') when 1 then replace(lower(event_type), '_', ' ') when 2 then 'été' else '' end, event_id) target, max(event_id)::varchar t from events group by 1) select sample_id as id, case when sample_id % 2 = 0 then replace(lower(n_name), '_', ' ') when sample_id % 3 = 0 then '' else coalesce(target, '') end as targets, case when sample_id % 2 = 1 then 't' else coalesce(m.t, '-') end as injected from home left join m on m.id = sample_id",
    "tg_cascades": CASCADES + " select id, 2 as steps, first_changed, first_hit, second_depends, second_hit, second_hit and first_hit as second_mentions_first, final_rr > 0 as final_hit, round(final_rr, 6)::double as final_rr from c",
    "tg_steps": f"with {catalogue.HOME} select sample_id as parent_id, 0::bigint as sub_id, 'where?' as question, sample_id % 3 > 0 as changed, false as needs_prev_answer, sample_id % 5 > 0 as hit from home union all select sample_id, 1, 'then?', sample_id % 4 = 0, sample_id % 2 = 0, sample_id % 7 = 0 from home",
    "tg_spread": f"with {catalogue.HOME} select round(100 * (count(*) filter (sample_id % 5 > 0) + count(*) filter (sample_id % 7 = 0)) / (2 * count(*)), 6) as shared_parent_spread_rate, round(100 * count(*) filter ((sample_id % 3 > 0 and sample_id % 5 > 0) or (sample_id % 4 = 0 and sample_id % 7 = 0)) / count(*), 6) as overall_parent_spread_rate, (2 * count(*))::bigint as shared_parent_total, count(*) as overall_parent_total from home",
    "tg_breakdown": CASCADES + ", a as (select 2 steps, *, final_rr > 0 final_hit, second_hit and first_hit second_mentions_first from c), d as (select * from a) select (select count(*) from a) as total" + answering.ORACLES["rb_stage_breakdown"].split(" as total", 1)[1],
    "qa_report": f"select o.n, o.hit, o.f1, r.original_hit, r.original_accuracy, h.score as hallucination_score from ({answering.ORACLES['qa_overview']}) o, (select round(100 * avg(hit), 6) original_hit, round(100 * avg(accuracy), 6) original_accuracy from ({answering.ORACLES['qa_original']})) r, ({answering.ORACLES['qa_hallucination_overview']}) h",
    "qa_evaluated": "with h as (select unnest([-1, 1, 2, 3]) hops), p as (select unnest(['all', 'good', 'bad']) part) select h.hops::int as hops, p.part, (select count(*) from customer where (h.hops < 0 or (h.hops = 3 and c_custkey % 5 >= 3) or (h.hops < 3 and c_custkey % 5 = h.hops)) and (p.part = 'all' or (p.part = 'good') = (c_custkey % 2 = 1))) as n from h, p",
    "pr_with_evidence": f"with {catalogue.HOME} select sample_id as id, 'drop' as way, n_name as t from home where sample_id not in {catalogue.WAITING} union all select sample_id, 'placeholder', case when sample_id not in {catalogue.WAITING} then n_name else '' end from home",
    "pr_question_entities": f"with {catalogue.HOME} select sample_id as id, case when sample_id % 4 = 0 then r_name when sample_id % 3 = 0 then n_name when sample_id % 5 = 0 then '' else c_name end as q_entity from home",
}
