"""Queries of relation paths, candidates, question steps and scores over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import candidates, text
from lattica.operators import conversation, decompose, model, prompts, rules
from lattica.plans import catalogue, prompting, selecting
from lattica.plans.catalogue import homes, scored, table

WHERE = "where is the customer"


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return homes(spark, sf_dir).select("sample_id", F.col("c_name").alias("entity"))


def _rules(s, d, t=None):
    return rules.rule_paths(catalogue.saved(s, d) if t is None else t, anchors(s, d), anchors(s, d).select("sample_id", F.lit(WHERE).alias("question")), 3)


def _candidates(s, d):
    t = catalogue.saved(s, d)
    return rules.rule_candidates(t, _rules(s, d, t), homes(s, d).select("sample_id", F.col("n_name").alias("entity")), anchors(s, d))


def _layered(s, d):
    """A sequence with repeats, one of support, and clean triples, of which those near the changed step lose; for odd
    samples also as they touch an answer."""
    t, h = catalogue.saved(s, d), homes(s, d)
    one = lambda layer, base, pos, *x: F.struct(F.lit(layer).alias("layer"), F.lit(base).alias("base"), F.lit(pos).alias("pos"), *(c.alias(n) for c, n in zip(x, "hrt")))
    new, other = (F.col("c_name"), F.lit("location.city"), F.lit("Atlantis")), (F.col("n_name"), F.lit("place.capital"), F.lit("Atlantis"))
    parts = F.array(one(0, 1.18, 0, *new), one(0, 1.18, 1, *other), one(0, 1.18, 2, *new), one(2, 0.5, 0, F.col("c_name"), F.lit("location.nation"), F.col("n_name")))
    changed = h.select("sample_id", F.lower("c_name").alias("start"), F.array(F.lit("Location.Nation"), F.lit("place.region")).alias("path"))
    known = h.where("sample_id % 2 = 1").select("sample_id", F.col("n_name").alias("entity"))
    out = rules.layered(t, h.select("sample_id", F.explode(parts).alias("x")).select("sample_id", "x.*"), rules.penalties(t, changed, known, 0.35, 0.75))
    return out.withColumn("score", F.round("score", 9))


#: Kinds of answers that names of parts are judged for.
SOME_KINDS = ("person", "city", "temporal", "language", "role", "open")


def _types(s, d):
    name = F.concat(F.initcap("p_name"), F.lit(" "), "p_type")
    return table(s, d, "part").select("p_partkey", *(candidates.type_score(name, F.lit(k)).alias(k) for k in SOME_KINDS), candidates.surface_ok(F.col("p_name")).alias("readable"), candidates.person_like(name).alias("person_like"))


def _dot_scores(s, d):
    e = table(s, d, "embeddings")
    first = e.groupBy("label").agg(F.min("vec_id").alias("vec_id")).join(e.select("vec_id", F.col("embedding").alias("q")), "vec_id").select("label", "q")
    dot = F.aggregate(F.zip_with("q", "embedding", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return e.join(first, "label").select("vec_id", "label", F.round(dot, 4).alias("score"))


def _steps(s, d):
    q = F.concat(F.lit("what nation is home of "), "c_name", F.lit(" that contains a lake"))
    return decompose.steps(homes(s, d).select(F.col("sample_id").alias("id"), q.alias("question"))).fillna(-1, ["dep_prev_sub_id"])


def _document_steps(s, d):
    return decompose.steps(table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("question")))


def _truncated(s, d):
    """Every block loses lines until at most 12 words are left."""
    asked = prompts.rendered(homes(s, d).select("sample_id", F.lit("where?").alias("question")), prompts.triplet_block(prompting._ordered(s, d), prompting.N))
    talks = asked.select(F.col("sample_id").alias("id"), conversation.conversation("Answer.", F.col("user_query")).alias("messages"), "lines")
    return conversation.truncated(talks, 44, 32).select("id", "removed", F.element_at("messages", -1)["content"].alias("content"))


def _encoded(s, d):
    e = model.embedded(table(s, d, "part").select(F.col("p_name").alias("text")))
    return e.select("text", F.size("embedding").alias("width"))


def _last_turn(s, d):
    turn = F.struct("turn", F.struct(F.lit("user").alias("role"), F.when(F.col("role") == "user", F.concat(F.lit("Triplets:\n"), "text")).otherwise(F.col("text")).alias("content")).alias("m"))
    talks = table(s, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(turn)), lambda x: x["m"]).alias("messages"))
    return talks.select("conv_id", conversation.evidence_turn(F.col("messages")).alias("at"))


QUERIES = {
    "kg_rule_paths": _rules,
    "kg_rule_candidates": _candidates,
    "kg_layered": _layered,
    "kg_dot_scores": _dot_scores,
    "kg_text_encoder": _encoded,
    "rb_type_score": _types,
    "rb_relation_score": lambda s, d: table(s, d, "nation").select("n_nationkey", candidates.relation_score(F.concat(F.lit("location.city.place"), "n_name"), F.lit(WHERE)).alias("place"), candidates.relation_score(F.concat(F.lit("film.book"), "n_name"), F.lit("who plays it")).alias("person"), text.answer_type(F.concat(F.lit("what language in "), "n_name")).alias("kind")),
    "rb_steps": _steps,
    "rb_document_steps": _document_steps,
    "conv_truncated": _truncated,
    "conv_evidence_turn": _last_turn,
}

RULES = """best as (select sample_id, h, r, t, max(score) score from triples group by all),
one as (select b.sample_id, r r1, null::varchar r2, null::varchar mid, t target, score, 1 hops from best b join home using (sample_id) where h = c_name),
two as (select o.sample_id, r1, b.r r2, target mid, b.t target, o.score + b.score score, 2 hops from one o join best b on b.sample_id = o.sample_id and b.h = o.target),
pathed as (select sample_id, r1, r2, hops, max(score) score, max_by((mid, target), (score, coalesce(mid, ''), target)) way from (select * from one union all select * from two) group by all),
fit as (select *, score + case hops when 2 then 0.15 else 0 end + case r1 when 'location.nation' then 0.7 else 0 end total from pathed),
ruled as (select sample_id, (row_number() over (partition by sample_id order by total desc, (r1 = 'location.nation') desc, hops desc, r1, r2))::int rank, r1, r2, way[1] mid, way[2] target, hops from fit qualify rank <= 3)"""
CANDIDATES = RULES + """,
led as (select o.sample_id, rank rule, o.target entity, max(o.score) score from ruled u join one o on o.sample_id = u.sample_id and o.r1 = u.r1 where u.r2 is null group by 1, 2, 3
  union all select o.sample_id, rank, o.target, max(o.score) from ruled u join two o on o.sample_id = u.sample_id and o.r1 = u.r1 and o.r2 = u.r2 group by 1, 2, 3)"""
LAYERS = """tops as (select sample_id, max(score) top from triples group by 1),
layers as (select 0 as layer, p pos, sample_id, case p when 2 then n_name else c_name end h, case p when 2 then 'place.capital' else 'location.city' end r, 'Atlantis' t, top + 1.18 - 0.001 * p score from home join tops using (sample_id), range(1, 4) g(p)
  union all select 2, 1, sample_id, c_name, 'location.nation', n_name, top + 0.499 from home join tops using (sample_id)
  union all select 9, rank, sample_id, h, r, t, score - case when r <> 'location.nation' then 0 when sample_id % 2 = 1 then 1.1 else 0.75 end from ranked)"""
#: The last lines of the evidence order go first: one, and one more for each 24 words beyond the 12 that may be left.
TRUNCATED = f"""{prompting.CLEAN},
lined as materialized (select sample_id, rank k, {prompting._line} line, len(string_split({prompting._line}, ' ')) w from placed where rank <= {prompting.N}),
sums as materialized (select sample_id, k l, (4 + sum(w) over (partition by sample_id order by k))::int used, string_agg(line, chr(10)) over (partition by sample_id order by k) lines from lined union all select sample_id, 0, 3, null from home),
walk as (select sample_id, max(k) l, max(k) m from lined group by 1 union all select x.sample_id, x.l - least(x.l, (used - 12) // 24 + 1), m from walk x join sums s on s.sample_id = x.sample_id and s.l = x.l where used > 12 and x.l > 0),
last as (select sample_id, min(l) l, max(m) m from walk group by 1)"""
ORACLES = {
    "kg_rule_paths": catalogue._sql("select sample_id, rank, r1, r2, mid as \"pivot\", target, hops from ruled", RULES),
    "kg_rule_candidates": catalogue._sql("select sample_id, rule, entity, (row_number() over (partition by sample_id, rule order by score desc, entity))::int as place from led join home using (sample_id) where entity <> n_name", CANDIDATES),
    "kg_layered": catalogue._sql("select layer, pos::int as pos, sample_id, h, r, t, round(score, 9) as score from layers", LAYERS),
    "kg_dot_scores": "select e.vec_id, e.label, round(list_inner_product(q.embedding::double[], e.embedding::double[]), 4) as score from embeddings e join (select label, arg_min(embedding, vec_id) embedding from embeddings group by 1) q using (label)",
    "kg_text_encoder": "select distinct p_name as text, 64 as width from part",
    "rb_type_score": f"select p_partkey, {', '.join(selecting.type_sql(repr(k)) + ' as ' + k for k in SOME_KINDS)}, length(p_name) > 2 as readable, person as person_like from (select *, {selecting.described('c')} from (select *, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || ' ' || p_type c from part))",
    "rb_relation_score": "select n_nationkey, 4 as place, -3 as person, 'language' as kind from nation",
    "rb_steps": f"with {catalogue.HOME} select sample_id::varchar as parent_id, sample_id::varchar as id, 0 as sub_id, 'what nation is home of ' || c_name || '?' as question, -1 as dep_prev_sub_id, 'none' as dep_type, false as needs_prev_answer from home union all select sample_id::varchar, sample_id || '_1', 1, 'Which is home of ' || c_name || ' of [B] contains a lake?', 0, 'coref', true from home",
    "conv_truncated": catalogue._sql("select x.sample_id as id, (m - x.l)::int as removed, case when x.l > 0 then 'Triplets:' || chr(10) || lines || chr(10) || chr(10) else '' end || 'Question:' || chr(10) || 'where?' as content from last x join sums s on s.sample_id = x.sample_id and s.l = x.l", TRUNCATED).replace("with ", "with recursive ", 1),
    "conv_evidence_turn": "select conv_id, max(case when role = 'user' then i end)::int as at from (select *, row_number() over (partition by conv_id order by turn) - 1 i from conversations) group by 1",
}
