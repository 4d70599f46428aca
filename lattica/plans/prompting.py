"""Queries of evidence order and prompts over the star-schema tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import text
from lattica.operators import prompts, retrieval
from lattica.plans import catalogue
from lattica.plans.catalogue import homes, scored, table
from lattica.sources import records

N = 20
MODES = ("rog_5", "rog_6_rmht", "rand_5", "randNoA_4_firstq", "noevi", "noevi_firstq")


def triples(spark: SparkSession, sf_dir: str, t: DataFrame | None = None) -> DataFrame:
    return retrieval.ranked(scored(spark, sf_dir) if t is None else t).select("sample_id", F.col("rank").alias("pos"), "h", "r", "t", "score")


def marks(spark: SparkSession, sf_dir: str, changed: bool = False) -> DataFrame:
    h = homes(spark, sf_dir)
    one = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("value"))
    kinds = [one("q", F.col("c_name")), one("a", F.col("n_name")), one("a", F.col("r_name"))]
    if changed:
        kinds += [one("start", F.col("c_name")), one("rule", F.lit("location.nation")), one("target", F.lit("Atlantis"))]
    return h.select("sample_id", F.explode(F.array(*kinds)).alias("x")).select("sample_id", "x.*")


def injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return homes(spark, sf_dir).select("sample_id", F.lit(0).alias("pos"), F.col("c_name").alias("h"), F.lit("location.city").alias("r"), F.lit("Atlantis").alias("t"), F.lit(0.9).alias("score"))


def sets(spark: SparkSession, sf_dir: str, changed: bool = False, t: DataFrame | None = None) -> DataFrame:
    new = injected(spark, sf_dir).select("sample_id", F.lit("injected").alias("kind"), "pos", "h", "r", "t")
    if not changed:
        return new.where("false")
    own = (scored(spark, sf_dir) if t is None else t).where("r = 'order.placed' and try_cast(substring(t, 3) as bigint) % 5 = 0")
    return new.unionByName(own.select("sample_id", F.lit("support").alias("kind"), F.lit(0).alias("pos"), "h", "r", "t"))


def _ordered(s, d, changed=False):
    saved = catalogue.saved(s, d)
    t = triples(s, d, saved)
    t = records.dealt(records.by(t.unionByName(injected(s, d))), records.scratch(s)) if changed else t
    return prompts.ordered(t, marks(s, d, changed), sets(s, d, changed, saved), changed)


def _blocks(s, d):
    out = prompts.rendered(homes(s, d).select("sample_id", F.concat(F.lit("where is "), "c_name").alias("question")), prompts.triplet_block(_ordered(s, d), N, 0.05, reverse=True), system="Answer.")
    return out.select("sample_id", "user_query", "all_query", F.size("lines").alias("n_lines"))


def _paths_first(s, d):
    paths = scored(s, d).where("r in ('location.nation', 'place.region')").select("sample_id", F.col("triple_id").alias("pos"), "h", "r", "t")
    return prompts.paths_first(paths, triples(s, d)).where(F.col("rank") <= N)


def _merged(heads):
    return lambda s, d: prompts.merged(table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.lit(1).alias("sample_id"), F.col("n_nationkey").alias("pos"), *([F.col("n_name").alias("h"), F.lit("in").alias("r"), F.col("r_name").alias("t")] if heads else [F.col("r_name").alias("h"), F.lit("has").alias("r"), F.col("n_name").alias("t")])), heads)


def _parsed(s, d):
    line = F.concat(F.lit("Reasoning Paths:\n"), "c_name", F.lit(" -> location.nation -> "), "n_name", F.lit(" -> place.region -> "), "r_name", F.lit("\n"), "c_name", F.lit(" -> alone\n\nQuestion:\nwhere?"))
    return homes(s, d).select("sample_id", F.posexplode(text.reasoning_triples(line)).alias("pos", "x")).select("sample_id", "pos", "x.*")


def _evidence(s, d):
    shown = F.concat(F.lit("Triplets:\n("), "c_name", F.lit(",a.b.c,"), "n_name", F.lit(")\n("), "n_name", F.lit(",a.b.d,"), "r_name", F.lit(")\n\nQuestion:\nwhere?"))
    made = F.concat(F.lit("evidence: ("), "r_name", F.lit(",a.b.d,"), "n_name", F.lit(")\nevidence: ("), "c_name", F.lit(",a.b.x,"), "n_name", F.lit(")\nevidence: none\nans: x"))
    out = prompts.labelled_evidence(homes(s, d).select(F.col("sample_id").alias("id"), shown.alias("user_query"), made.alias("prediction")))
    return out.select("id", "cited", "missing", F.concat_ws("|", F.transform("evidence", lambda x: text.triple_text(x["h"], x["r"], x["t"]))).alias("evidence"))


def _plans(s, d):
    e = table(s, d, "events")
    return prompts.plan_block(e.select(F.expr("event_id div 3").alias("sample_id"), (F.col("event_id") % 3).cast("int").alias("sub_id"), F.col("event_type").alias("question"), F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 3 - 1).alias("dep_prev_sub_id"), F.lit("bridge").alias("dep_type"), (F.col("event_id") % 3 > 0).alias("needs_prev_answer")))


def _modes(s, d):
    """Prompts of all customers in each mode that pr_prompt doesn't show."""
    t = catalogue.saved(s, d)
    ask = homes(s, d).select("sample_id", F.concat(F.lit("where is "), "c_name").alias("question"))
    paths = t.where("r in ('location.nation', 'place.region')").select("sample_id", F.col("triple_id").alias("pos"), "h", "r", "t")
    ranks = retrieval.ranked(t).select("sample_id", F.col("rank").alias("pos"), "h", "r", "t", "score")
    out = None
    for mode in MODES:
        own = prompts.by_mode(mode, ask, ranks, paths=paths, triples=t, answers=catalogue.answers(s, d), system="Answer.").select("sample_id", F.lit(mode).alias("mode"), "user_query", "all_query", F.size("lines").alias("n_lines"))
        out = own if out is None else out.unionByName(own)
    return out


def _loaded(s, d):
    """Customers with an order without items have no evidence, and others lack the place in theirs. Entities are known, the
    graph's or a path's, by region."""
    h = homes(s, d)
    rows = h.select(F.col("sample_id").alias("id"), F.array(F.concat("c_name", F.lit(" -> location.nation -> "), "n_name")).alias("paths"))
    graphs = h.select(F.col("sample_id").alias("id"), F.when(F.col("r_name") < "B", F.array("n_name")).otherwise(F.array().cast("array<string>")).alias("q_entity"))
    triple = F.struct("h", "r", "t", "score")
    placed = scored(s, d).where("r = 'order.placed'").groupBy("sample_id").agg(F.array_sort(F.collect_list(triple)).alias("found"))
    place = F.array(F.struct(F.col("c_name").alias("h"), F.lit("location.nation").alias("r"), F.col("n_name").alias("t")), F.struct(F.col("n_name").alias("h"), F.lit("place.region").alias("r"), F.col("r_name").alias("t")))
    evidence = placed.join(catalogue.waiting(s, d), "sample_id", "left_anti").join(h.select("sample_id", place.alias("relevant")), "sample_id").withColumnRenamed("sample_id", "id")
    known = h.where("r_name >= 'M'").select(F.col("sample_id").alias("id"), F.array("r_name").alias("q_entity"))
    out = None
    for way, own, mode in (("other system", "triples", "scored_100"), ("relevant", "scored_triples", "scored_100_gt")):
        got = prompts.loaded(rows, graphs, evidence.withColumnRenamed("found", own), known, mode)
        got = got.select("id", F.lit(way).alias("way"), F.concat_ws("|", "q_entity").alias("q_entity"), F.size("triples").alias("n"), F.get("triples", F.lit(0))["t"].alias("first"), F.round(F.aggregate("triples", F.lit(0.0), lambda a, x: a + F.coalesce(x["score"], F.lit(0.0))), 4).alias("score"))
        out = got if out is None else out.unionByName(got)
    return out


QUERIES = {
    "pr_order": _ordered,
    "pr_order_changed": lambda s, d: _ordered(s, d, True),
    "pr_prompt": _blocks,
    "pr_paths_first": _paths_first,
    "pr_shuffled": lambda s, d: prompts.shuffled(scored(s, d)).select("sample_id", "rank", "h", "r", "t"),
    "pr_merged_heads": _merged(True),
    "pr_merged_tails": _merged(False),
    "pr_reasoning_triples": _parsed,
    "pr_labelled_evidence": _evidence,
    "pr_plan_block": _plans,
    "pr_modes": _modes,
    "pr_loaded": _loaded,
}

#: The graphs are trees from the customer, so the waves follow from the relation.
CLEAN = """kinds as (select t.sample_id, h, r, t.t, score, rank pos, case when r in ('location.nation', 'order.placed') then 1 else 2 end wave, (h = c_name)::int seed, (h in (n_name, r_name) or t.t in (n_name, r_name))::int a from ranked t join home using (sample_id)),
once as (select * from kinds qualify row_number() over (partition by sample_id, h, r, t order by wave, seed desc, a desc, score desc, pos) = 1),
placed as (select sample_id, h, r, t, score, (row_number() over (partition by sample_id order by wave, seed desc, a desc, score desc, pos))::int rank, count(*) over (partition by sample_id) n, case when seed + a > 0 then 'neighbor' else 'filler' end bucket from once)"""
CHANGED = """kinds as (select t.sample_id, h, r, t.t, score, rank pos, (h = c_name)::int seed, (h in (n_name, r_name) or t.t in (n_name, r_name))::int a, (r = 'order.placed' and coalesce(try_cast(substr(t.t, 3) as bigint) % 5 = 0, false))::int support,
    (r = 'order.item' and coalesce(try_cast(substr(h, 3) as bigint) % 5 = 0, false)) near, 0 injected from ranked t join home using (sample_id) where r <> 'location.nation'
  union all select sample_id, c_name, 'location.city', 'Atlantis', 0.9, 0, 1, 0, 0, false, 1 from home),
parts as (select distinct sample_id, t from kinds where near),
waved as (select k.*, case when injected + support > 0 then 0 when r = 'place.region' then 2 else 1 end stage, case when r = 'order.placed' or near then 1 else 2 end wave, (near or p.t is null)::int fresh from kinds k left join parts p on p.sample_id = k.sample_id and p.t = k.t and r = 'order.item'),
once as (select * from waved qualify row_number() over (partition by sample_id, h, r, t order by score desc, pos) = 1),
placed as (select sample_id, h, r, t, score, (row_number() over (partition by sample_id order by stage, case when stage = 1 then wave end, case when stage = 1 then fresh end desc, injected desc, support desc, seed desc, a desc, score desc, pos))::int rank, count(*) over (partition by sample_id) n,
  case when injected = 1 then 'attack' when support = 1 then 'support' when seed + a > 0 then 'neighbor' else 'filler' end bucket from once)"""
_places = "select sample_id, h, r, t, score, rank, n - rank + 1 as priority, bucket from placed"
_line = "'(' || h || ',' || r || ',' || t || ')'"
_asked = "'Question:' || chr(10) || 'where is ' || c_name || '?'"
_two = "chr(10) || chr(10)"


def _mode_sql(mode: str, first: bool, lines: str | None, n: int = 0) -> str:
    """lines: sample_id, line, place. Of equal lines the first counts; n lines a sample."""
    if lines is None:
        user = f"{_asked} || {_two}" if first else _asked
        return f"select sample_id, '{mode}' as mode, {user} as user_query, 'Answer.' || {_two} || {user if first else f'{_two} || {_asked}'} as all_query, 0 as n_lines from home"
    shown = f"select sample_id, string_agg(line, chr(10) order by k) shown, count(*)::int n from (select *, row_number() over (partition by sample_id order by place) k from (select sample_id, line, min(place) place from ({lines}) group by all) qualify k <= {n}) group by 1"
    given = "'Triplets:' || chr(10) || coalesce(shown, '')"
    user = f"{_asked} || {_two} || {given}" if first else f"{given} || {_two} || {_asked}"
    return f"select h.sample_id, '{mode}' as mode, {user} as user_query, 'Answer.' || {_two} || {user} as all_query, coalesce(n, 0) as n_lines from home h left join ({shown}) x on x.sample_id = h.sample_id"


_dealt = "md5(concat_ws('|', '0', sample_id, h, r, t))"
_both = lambda few: f"select sample_id, {_line} line, (0, triple_id) place from ranked where r in ('location.nation', 'place.region') union all select sample_id, {_line}, (1, rank) from (select * from ranked {few}) x"
_mode_parts = [
    _mode_sql("rog_5", False, _both(""), 5),
    _mode_sql("rog_6_rmht", False, _both("qualify row_number() over (partition by sample_id, least(h, t), greatest(h, t) order by rank) = 1"), 6),
    _mode_sql("rand_5", False, f"select sample_id, {_line} line, ({_dealt}, h, r, t) place from triples", 5),
    _mode_sql("randNoA_4_firstq", True, f"select sample_id, {_line} line, ({_dealt}, h, r, t) place from triples join home using (sample_id) where not (contains(h, n_name) or contains(h, r_name) or contains(t, n_name) or contains(t, r_name))", 4),
    _mode_sql("noevi", False, None),
    _mode_sql("noevi_firstq", True, None),
]
_entities = "case when r_name >= 'M' then r_name when r_name < 'B' then n_name else c_name end as q_entity"
_placed = "select sample_id, count(*)::int n, min_by(t, (h, r, t, score)) t, sum(score) score from triples where r = 'order.placed' and sample_id not in " + catalogue.WAITING + " group by 1"
ORACLES = {
    "pr_modes": catalogue._sql(" union all ".join(_mode_parts)),
    "pr_loaded": catalogue._sql(f"select h.sample_id as id, 'other system' as way, {_entities}, coalesce(n, 1) as n, coalesce(p.t, '') as first, round(coalesce(score, 0), 4) as score from home h left join placed p using (sample_id) union all select sample_id, 'relevant', {_entities}, n + 2, r_name, round(score, 4) from home join placed using (sample_id)", f"placed as ({_placed})"),
    "pr_order": catalogue._sql(_places, CLEAN),
    "pr_order_changed": catalogue._sql(_places, CHANGED),
    "pr_prompt": catalogue._sql(f"select sample_id, user_query, 'Answer.' || chr(10) || chr(10) || user_query as all_query, n::int as n_lines from (select sample_id, 'Triplets:' || chr(10) || string_agg({_line}, chr(10) order by k desc) || chr(10) || chr(10) || 'Question:' || chr(10) || 'where is ' || c_name || '?' user_query, count(*) n from (select *, row_number() over (partition by sample_id order by rank) k from placed where score >= 0.05 qualify k <= {N}) join home using (sample_id) group by sample_id, c_name)", CLEAN),
    "pr_paths_first": catalogue._sql(f"select sample_id, (row_number() over (partition by sample_id order by st, pos))::int as rank, h, r, t from (select sample_id, h, r, t, case when r in ('location.nation', 'place.region') then 0 else 1 end st, min(case when r in ('location.nation', 'place.region') then triple_id else rank end) pos from ranked group by all) qualify rank <= {N}"),
    "pr_shuffled": catalogue._sql("select sample_id, (row_number() over (partition by sample_id order by md5(concat_ws('|', '0', sample_id, h, r, t)), h, r, t))::int as rank, h, r, t from (select distinct sample_id, h, r, t from triples)"),
    "pr_merged_heads": "select 1 as sample_id, min(n_nationkey) as pos, '[' || string_agg(n_name, ',' order by n_nationkey) || ']' as h, 'in' as r, r_name as t from nation join region on n_regionkey = r_regionkey group by r_name",
    "pr_merged_tails": "select 1 as sample_id, min(n_nationkey) as pos, r_name as h, 'has' as r, '[' || string_agg(n_name, ',' order by n_nationkey) || ']' as t from nation join region on n_regionkey = r_regionkey group by r_name",
    "pr_reasoning_triples": f"with {catalogue.HOME} select sample_id, 0 as pos, c_name as h, 'location.nation' as r, n_name as t from home union all select sample_id, 1, n_name, 'place.region', r_name from home",
    "pr_labelled_evidence": f"with {catalogue.HOME} select sample_id as id, 2 as cited, 1 as missing, '(' || r_name || ',a.b.d,' || n_name || ')' as evidence from home",
    "pr_plan_block": "select sample_id, 'Dependency-Aware Subquestions:' || chr(10) || 'Solve the following subquestions in order before answering the original question.' || chr(10) || string_agg('[Step ' || (sub_id + 1) || '] ' || event_type || ' (dependency: ' || case when sub_id > 0 then 'depends on step ' || sub_id else 'independent' end || '; type: bridge)', chr(10) order by sub_id) || chr(10) || 'Use the answer from each earlier step when a later step depends on it.' as plan from (select event_id // 3 sample_id, event_id % 3 sub_id, event_type from events) group by 1 having count(*) > 1",
}
