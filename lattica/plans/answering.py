"""Queries of the answer metrics over the star-schema tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import text
from lattica.operators import answers, metrics
from lattica.plans.catalogue import HOME, NORMAL, homes, table


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as questions with six kinds of predictions; every fourth one's graph has no answer."""
    k = F.col("sample_id") % 6
    line = lambda *xs: F.concat(*(F.lit(x) if x.startswith(("ans", "\n", "I ", "!")) else F.col(x) for x in xs))
    p = (
        F.when(k == 0, line("ans: ", "n_name", "\nans: The ", "r_name", "!"))
        .when(k == 1, line("ans: ", "c_name", "\nans: ", "n_name"))
        .when(k == 2, F.lit(""))
        .when(k == 3, line("I think so\nans: none of them"))
        .when(k == 4, line("ans: not available"))
        .otherwise(line("ans: ", "r_name", "\nans: ", "c_name", "\nans: ", "r_name"))
    )
    q = F.when(F.col("sample_id") % 2 == 0, F.concat(F.lit("where is "), "c_name")).otherwise(F.concat(F.lit("who supplies "), "c_name"))
    return homes(spark, sf_dir).select(
        F.col("sample_id").alias("id"),
        q.alias("question"),
        p.alias("prediction"),
        F.array("r_name", "n_name").alias("answers"),
        (F.col("sample_id") % 4 != 3).alias("answerable"),
        F.array("c_name", "n_name").alias("evidence"),
        F.array(F.struct(F.col("c_name").alias("h"), F.lit("location.nation").alias("r"), F.col("n_name").alias("t"))).alias("injected"),
        F.when(F.col("sample_id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("Triplets:\n("), "c_name", F.lit(", location.nation ,"), "n_name", F.lit(")"))).alias("prompt"),
    )


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = rows(spark, sf_dir)
    return own.withColumn("targets", F.when(F.col("id") % 7 == 0, F.array().cast("array<string>")).otherwise(F.slice("answers", 1, 1)))


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select((k % 4).alias("steps"), (k % 3 > 0).alias("first_changed"), (k % 5 > 1).alias("first_hit"), (k % 7 > 2).alias("second_depends"), (F.col("value") > 20).alias("second_hit"), (k % 6 > 3).alias("second_mentions_first"), (F.col("value") > 60).alias("final_hit"), (1.0 / (1 + k % 4)).alias("final_rr"))


def _attack_rates(s, d):
    """Predictions with answer lines, without any, with empty ones and none; a third of them has no targets."""
    i, h = F.col("sample_id"), homes(s, d)
    said = F.when(i % 5 == 0, F.concat(F.lit("I think\nans: the "), "n_name", F.lit("\nso ans: "), "r_name")).when(i % 5 == 1, F.concat(F.lit("  "), F.lower("r_name"), F.lit(" "))).when(i % 5 == 2, "ans: ").when(i % 5 == 3, F.concat(F.lit("ans: x\nans: "), "r_name", F.lit("!")))
    return metrics.attack_rates(h.select(i.alias("id"), said.alias("prediction")), h.where("sample_id % 3 > 0").select(i.alias("id"), F.array(F.concat("r_name", F.lit(".")), F.lit(" ")).alias("targets")))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select("id", *(F.round(F.col(c).cast("double"), 6).alias(c) for c in names))


def _votes(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("pos"), F.col("event_type").alias("prediction"))
    return answers.votes(e, 2)


def _lines(s, d):
    p = F.col("prediction")
    return rows(s, d).select("id", F.concat_ws("|", text.answer_lines(p)).alias("lines"), F.concat_ws("|", text.marked_answers(p)).alias("marked"), F.concat_ws("|", text.loose_answers(p)).alias("loose"), text.without_answer(p).alias("no_answer"), text.two_way(F.col("question")).alias("two_way"))


SCORES = ("n_predictions", "n_answers", "n_matched", "hit", "precision", "recall", "f1")
QUERIES = {
    "qa_lines": _lines,
    "qa_one_to_one": lambda s, d: _rounded(answers.one_to_one(rows(s, d)), *SCORES),
    "qa_overview": lambda s, d: answers.overview(answers.one_to_one(rows(s, d))),
    "qa_hallucination": lambda s, d: _rounded(answers.hallucination(rows(s, d)), "score", *answers.COUNTERS),
    "qa_hallucination_overview": lambda s, d: answers.hallucination_overview(answers.hallucination(rows(s, d))),
    "qa_original": lambda s, d: _rounded(answers.original(rows(s, d)), "hit", "accuracy", "precision", "recall", "f1"),
    "qa_votes": _votes,
    "rb_stage_metrics": lambda s, d: answers.stage_metrics(staged(s, d)),
    "rb_attack_rates": _attack_rates,
    "rb_stage_breakdown": lambda s, d: answers.stage_breakdown(details(s, d)),
}

#: An answer matches at most one line of these predictions, so counts over sets equal the one-to-one ones.
BASE = f"""{HOME},
own as (select sample_id id, case sample_id % 2 when 0 then 'where is ' || c_name else 'who supplies ' || c_name end question, c_name, n_name, r_name,
  case sample_id % 6 when 0 then 'ans: ' || n_name || chr(10) || 'ans: The ' || r_name || '!' when 1 then 'ans: ' || c_name || chr(10) || 'ans: ' || n_name when 2 then ''
    when 3 then 'I think so' || chr(10) || 'ans: none of them' when 4 then 'ans: not available' else 'ans: ' || r_name || chr(10) || 'ans: ' || c_name || chr(10) || 'ans: ' || r_name end prediction,
  [r_name, n_name] answers, sample_id % 4 <> 3 answerable, case when sample_id % 5 = 0 then '' else 'Triplets:' || chr(10) || '(' || c_name || ', location.nation ,' || n_name || ')' end prompt from home),
lined as (select *, sample_lines l, sample_id2 two, len(sample_lines) = 0 or contains(prediction, 'ans: not available') no_answer from (select *, question like 'where%' sample_id2,
  case id % 6 when 0 then ['ans: ' || n_name, 'ans: The ' || r_name || '!'] when 1 then ['ans: ' || c_name, 'ans: ' || n_name] when 5 then ['ans: ' || r_name, 'ans: ' || c_name] else []::varchar[] end sample_lines from own)),
agree as (select id, x line, i, y answer, contains({NORMAL('x')}, {NORMAL('y')}) or (two and contains({NORMAL('y')}, {NORMAL("replace(x, 'ans: ', '')")})) ok,
  contains(lower(c_name), lower(replace(x, 'ans: ', ''))) or contains(lower(x), lower(c_name)) or contains(lower(n_name), lower(replace(x, 'ans: ', ''))) or contains(lower(x), lower(n_name)) seen
  from (select *, unnest(l) x, generate_subscripts(l, 1) i from lined), unnest(answers) t(y)),
per_line as (select id, i, any_value(seen) seen, bool_or(ok) ok from agree group by all),
counted as (select o.id, len(l)::int n_predictions, 2 n_answers, coalesce(a.n, 0)::int n_matched, coalesce(a.h, 0)::int hit, no_answer, answerable from lined o left join (select id, count(distinct answer) filter (ok) n, max((ok and i = 1)::int) h from agree group by 1) a using (id)),
scored as (select *, coalesce(n_matched / nullif(n_predictions, 0), 0)::double p, (n_matched / n_answers)::double r from counted),
scores as (select *, case when p + r > 0 then 2 * p * r / (p + r) else 0 end::double f from scored),
hal as (select o.id, o.answerable, o.no_answer, coalesce(ci, 0)::int correct_in_graph, coalesce(co, 0)::int correct_out_graph, coalesce(wi, 0)::int wrong_in_graph, coalesce(wo, 0)::int wrong_out_graph,
  case when o.answerable then case when o.no_answer then 0 else (ci + co - wi - wo) / len(l) end else case when o.no_answer then 1 else (-ci - wi - 1.5 * (co + wo)) / len(l) end end::double score
  from lined o left join (select id, count(*) filter (ok and seen and answerable) ci, count(*) filter (ok and not seen) co, count(*) filter (seen and not (ok and answerable)) wi, count(*) filter (not ok and not seen) wo from per_line join lined using (id) group by 1) c using (id))"""


def _sql(body: str) -> str:
    return f"with {BASE} {body}"


_pct = lambda x: f"round(100 * coalesce({x}, 0), 6)::double"
_rate = lambda of, x: _pct(f"avg(case when {of} then ({x})::double end)")
_LOST = "case when first_changed and not first_hit then 'first' when second_depends and not second_hit then 'second' when second_hit and not final_hit then 'final' when final_hit then 'none' end"
_kind = lambda name, flag: f"count(*) filter ({flag}) {name}_rows, count(*) filter ({flag} and no_answer) {name}_no_answer, " + ", ".join(f"sum(case when {flag} then {c} else 0 end)::bigint {name}_{c}" for c in answers.COUNTERS)
ORACLES = {
    "rb_attack_rates": f"with {HOME}, p as (select case sample_id % 5 when 0 then 2 when 3 then 2 when 1 then 1 else 0 end n, case sample_id % 5 when 0 then 2 when 3 then 2 when 1 then 1 end place from home where sample_id % 3 > 0) select count(*) as n, round(100 * avg(coalesce(1 / nullif(case when place > 0 then n else 0 end, 0), 0)), 6) as a_precision, round(100 * avg((coalesce(place, 0) = 1)::int), 6) as a_hit1, round(100 * avg(coalesce(1 / place, 0)), 6) as a_mrr from p",
    "qa_lines": _sql("select id, array_to_string(l, '|') as lines, case when id % 6 = 5 then r_name || '|' || c_name || '|' || r_name when id % 6 = 3 then 'none of them' when id % 6 = 4 then 'not available' else replace(array_to_string(l, '|'), 'ans: ', '') end as marked, case when id % 6 = 5 then r_name || '|' || c_name || '|' || r_name when id % 6 = 3 then 'none of them' when id % 6 = 4 then 'not available' else replace(array_to_string(l, '|'), 'ans: ', '') end as loose, no_answer, two as two_way from lined"),
    "qa_one_to_one": _sql("select id, n_predictions::double as n_predictions, n_answers::double as n_answers, n_matched::double as n_matched, hit::double as hit, round(p, 6) as precision, round(r, 6) as recall, round(f, 6) as f1 from scores"),
    "qa_overview": _sql(f"select count(*) as n, {_pct('avg(hit)')} as hit, {_pct('avg(f)')} as f1, {_pct('avg(p)')} as precision, {_pct('avg(r)')} as recall, {_pct('avg((f = 1)::int)')} as exact, {_pct('avg((r = 0)::int)')} as wrong, {_pct('sum(n_matched) / sum(n_predictions)')} as micro_precision, {_pct('sum(n_matched) / sum(n_answers)')} as micro_recall, {_pct('2 * sum(n_matched) / (sum(n_predictions) + sum(n_answers))')} as micro_f1, count(*) filter (no_answer) as no_answer from scores"),
    "qa_hallucination": _sql("select id, round(score, 6) as score, " + ", ".join(f"{c}::double as {c}" for c in answers.COUNTERS) + " from hal"),
    "qa_hallucination_overview": _sql(f"select count(*) as n, round((avg(score) + 1.5) / 2.5 * 100, 6) as score, {_kind('good', 'answerable')}, {_kind('bad', 'not answerable')} from hal"),
    "qa_original": _sql(f"""select id, hit, accuracy, precision, recall, case when precision + recall > 0 then round(2 * p * r / (p + r), 6) else 0 end::double as f1 from (select *, round(p, 6) as precision, round(r, 6) as recall from (select o.id, case when prediction = '' then 1 else coalesce(a.hit, 0) end::double as hit, round(n / 2, 6)::double as accuracy, case when prediction = '' then 0 else n / len(string_split(prediction, chr(10))) end::double p, (n / 2)::double r from (select *, (contains({NORMAL('prediction')}, {NORMAL('r_name')})::int + contains({NORMAL('prediction')}, {NORMAL('n_name')})::int) n from own) o left join (select id, max(ok::int) hit from agree group by 1) a using (id)))"""),
    "qa_votes": "select user_id as id, event_type as prediction, count(*) as n, (row_number() over (partition by user_id order by count(*) desc, min(event_id)))::int as rank from events group by 1, 2 qualify rank <= 2",
    "rb_stage_metrics": _sql(f"select count(*) as n, count(*) filter (retrieved) as n_retrieved, count(*) filter (hits > 0) as n_generated, {_pct('avg(retrieved::int)')} as retrieval_rate, {_pct('avg(case when retrieved then (hits > 0)::int end)')} as generation_rate, {_pct('avg(case when hits > 0 then hits / n end)')} as precision from (select id % 5 <> 0 retrieved, case id % 6 when 0 then 1 when 5 then 2 else 0 end hits, case id % 6 when 0 then 2 when 5 then 3 else 1 end n from own where id % 7 <> 0)"),
    "rb_stage_breakdown": f"with a as (select event_id % 4 steps, event_id % 3 > 0 first_changed, event_id % 5 > 1 first_hit, event_id % 7 > 2 second_depends, value > 20 second_hit, event_id % 6 > 3 second_mentions_first, value > 60 final_hit, 1.0 / (1 + event_id % 4) final_rr from events), d as (select * from a where steps >= 2) select (select count(*) from a) as total, count(*) as n, count(*) filter (first_changed) as n_first_changed, count(*) filter (second_depends) as n_second_depends, {_rate('first_changed', 'first_hit')} as first_rate, {_rate('second_depends', 'second_hit')} as second_rate, {_rate('first_changed and first_hit', 'second_hit')} as second_given_first, {_rate('second_depends', 'second_mentions_first')} as mention_rate, {_rate('first_changed and first_hit', 'second_mentions_first')} as mention_given_first, {_rate('true', 'final_hit')} as final_rate, {_rate('first_changed and first_hit', 'final_hit')} as final_given_first, {_rate('second_depends and second_hit', 'final_hit')} as final_given_second, {_rate('true', 'final_rr')} as final_mrr, {_rate('first_changed and first_hit', 'final_rr')} as final_mrr_given_first, " + ", ".join(f"count(*) filter ({_LOST} = '{x}') as lost_{x}" for x in ("first", "second", "final", "none")) + " from d",
}
