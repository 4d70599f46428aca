"""Queries of how candidates suit a question and which are chosen, over the star-schema tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import candidates, suitability, text
from lattica.operators import selection
from lattica.plans import catalogue
from lattica.plans.catalogue import homes, table
from lattica.sources import records

#: Questions of seven kinds, four relations and eight names, which parts meet in all combinations.
ASKED = ("who wrote it", "where is it located", "when was it", "what language is spoken", "what did they work as", "which one", "what country is it")
KINDS = ("person", "location", "temporal", "language", "role", "open", "country")
RELATIONS = ("place.country", "person.author", "profession.office", "type.object.type")
NAMES = ("English", "French language", None, "Film Album", "Vice President", "country", None, None)


def _pick(number, values):
    return F.element_at(F.array(*map(F.lit, values)), (number + 1).cast("int"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, size = F.col("p_partkey"), F.col("p_size")
    made = F.when(i % 8 == 2, (1400 + i % 800).cast("string")).when(i % 8 == 6, F.concat(F.lit(" "), F.initcap("p_name"))).otherwise(F.concat(F.lit("City of "), "p_name"))
    return records.spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")).select(
        "p_partkey", F.coalesce(_pick(i % 8, NAMES), made).alias("name"), _pick(i % 7, ASKED).alias("question"), _pick(size % 4, RELATIONS).alias("relation"),
        F.slice(F.array(F.initcap("p_name")), F.lit(1), (size % 2).cast("int")).alias("answers"), F.when(size % 5 > 0, "english").alias("natural"), F.when(size % 8 < 4, "Person.Author").alias("r2"), (size % 10).alias("place"),
    )


def _suitability(s, d):
    c, q, r, a = (F.col(x) for x in ("name", "question", "relation", "answers"))
    kind, r1 = text.answer_type(q), F.lit("place.country")
    return parts(s, d).select(
        "p_partkey", kind.alias("kind"), candidates.type_score(c, kind).alias("type_score"), candidates.type_fits(c, kind).alias("type_fits"), suitability.meaning_score(c, q, r).alias("meaning"),
        suitability.plausible(c, q).alias("plausible"), candidates.shape_similarity(c, a, kind).alias("shape"), suitability.shape_fits(c, a, kind).alias("shape_fits"),
        suitability.choice_score(c, a, q, r, F.col("natural"), F.col("place")).alias("choice"), suitability.spelled(c, q).alias("spelled"), F.concat_ws("|", suitability.all_spellings(F.array(c, F.lit("x"), c), q)).alias("spellings"),
        suitability.support_score(r, q, r1, F.col("r2")).alias("support"), suitability.direct_score(r, q).alias("direct"), suitability.bridge_name(c, F.lit("-Été 1"), r, F.col("r2")).alias("bridge"),
        F.round(suitability.repeat_boost(F.col("place"), F.lit(2)), 6).alias("boost"), F.concat_ws("|", suitability.known_answers(F.array(c, F.lit(" ")), a, F.lit(None).cast("array<string>"))).alias("known"),
    )


#: Names, and the ways that choose them where a place is asked for, and where anything is.
OFFERED = (
    (None, "pivot between soft final", "pivot between soft final rule global"),
    (None, "pivot between soft final", "pivot between soft final rule global"),
    (None, "", ""),
    (None, "", ""),
    ("ab", "", ""),
    ("Country", "pivot final", "pivot final"),
    ("ISBN 1", "pivot soft", "pivot soft"),
    ("m.0abc", "", ""),
    ("Atlantis", "pivot between soft final rule global", "pivot between soft final rule global"),
    ("xyz", "between soft final", "between soft final rule global"),
    ("Film City", "pivot soft final", "pivot soft final rule global"),
    ("lake songs", "pivot soft final", "pivot soft final rule global"),
    ("writer", "pivot soft final", "pivot soft final global"),
)


def _chosen(s, d):
    """Six ways; the third name is blocked, the fourth repeats the second."""
    own = [F.col("c_name"), F.concat(F.lit(" "), "n_name", F.lit("\t")), F.col("r_name"), F.col("n_name"), *(F.lit(x[0]) for x in OFFERED[4:])]
    h = records.spread(homes(s, d))
    rows = h.select("sample_id", F.posexplode(F.array(*own)).alias("pos", "entity"), F.when(F.col("sample_id") % 2 == 0, "where is it").otherwise("which one").alias("question"), F.lit("place.in").alias("r1"), F.lit(None).cast("string").alias("r2"))
    blocked, out = h.select("sample_id", F.concat(F.lit(" "), F.lower("r_name")).alias("entity")), None
    for way in ("pivot", "between", "soft", "final", "rule", "global"):
        one = selection.chosen(rows, blocked, way).select("sample_id", F.lit(way).alias("way"), "pos", "entity")
        out = one if out is None else out.unionByName(one)
    return out


def _shaped(s, d):
    even = F.col("sample_id") % 2 == 0
    names = F.when(even, F.array(F.lit("one two three"), F.lit("x y"))).otherwise(F.array(F.lit("a b c d e")))
    return selection.shaped(homes(s, d).select("sample_id", F.explode(names).alias("entity"), F.array("r_name").alias("answers"), F.lit("open").alias("kind"))).select("sample_id", "entity")


def _support(s, d):
    h = homes(s, d)
    wanted = h.select("sample_id", F.col("c_name").alias("start"), F.col("r_name").alias("target"), F.col("n_name").alias("pivot"), F.lit("location.nation").alias("r1"), F.lit("place.region").alias("r2"), F.lit("where is the customer").alias("question"))
    injected = h.select("sample_id", F.col("c_name").alias("h"), F.lit("location.nation").alias("r"), F.col("n_name").alias("t"))
    return selection.support(catalogue.scored(s, d), wanted, injected)


def _primary(s, d):
    one = lambda h, r, t: F.struct(h.alias("h"), F.lit(r).alias("r"), t.alias("t"))
    c, n, r, new = F.col("c_name"), F.col("n_name"), F.col("r_name"), F.lit("Atlantis")
    detail = lambda target, *triples: F.struct(target.alias("target"), F.array(*triples).alias("triples"))
    details = F.array(detail(n, one(c, "in", n)), detail(F.concat(F.lower(n), F.lit(" ")), one(c, "in", n), one(n, "in", r)), detail(F.lit(" "), one(r, "has", n)), detail(r, one(c, "in", r)), detail(new, one(c, "in", new), one(c, "in", n)))
    return selection.primary_and_other(homes(s, d).select("sample_id", F.posexplode(details).alias("pos", "x")).select("sample_id", "pos", "x.*"), 2)


def _best(s, d):
    """Eight names a sample, of which the second is inherited; two paths, or for every fifth sample none."""
    p, i = parts(s, d), F.floor(F.col("p_partkey") / 8)
    rows = p.select(i.alias("sample_id"), (F.col("p_partkey") % 8).alias("pos"), F.col("name").alias("entity"), "question", "answers", (F.col("p_partkey") % 8 == 1).alias("inherited"))
    path = lambda r, natural: F.struct(F.lit(r).alias("r1"), F.lit(None).cast("string").alias("r2"), F.lit(natural).cast("string").alias("natural"))
    paths = rows.select("sample_id").distinct().where("sample_id % 5 > 0").select("sample_id", F.explode(F.array(path(RELATIONS[0], "english"), path(RELATIONS[1], None))).alias("x")).select("sample_id", "x.*")
    return selection.best_targets(rows, paths, 3).select("sample_id", "place", "entity", F.col("score").cast("int").alias("score"))


def _repeated(s, d):
    i, h = F.col("sample_id"), homes(s, d)
    triples = F.array(F.struct(F.col("c_name").alias("h"), F.lit("in").alias("r"), F.col("n_name").alias("t")), F.struct(F.col("n_name").alias("h"), F.lit("in").alias("r"), F.col("r_name").alias("t")))
    details = h.select("sample_id", F.lit(0).alias("pos"), (i % 2 == 0).alias("is_primary"), (i % 3 == 0).alias("depends"), (i % 5 == 0).alias("cascading"), triples.alias("triples"))
    return selection.repeated(details, 3, 0, 2)


def _listed(s, d):
    """Replies as objects, arrays, in fences, in sentences, and none."""
    i, n = F.col("n_nationkey"), F.concat(F.lit('["'), "n_name", F.lit('", "x"]'))
    reply = (
        F.when(i % 7 == 0, F.concat(F.lit('{"targets": '), n, F.lit("}"))).when(i % 7 == 1, n).when(i % 7 == 2, F.concat(F.lit("```JSON\n"), n, F.lit("\n```")))
        .when(i % 7 == 3, F.concat(F.lit('I say:\n{"answers": '), n, F.lit(', "targets": "no list"} so.'))).when(i % 7 == 4, F.concat(F.lit("these: "), n, F.lit(" all"))).when(i % 7 == 5, "nothing")
    )
    return table(s, d, "nation").select("n_nationkey", F.concat_ws("|", F.coalesce(suitability.listed(reply), F.array(F.lit("-")))).alias("targets"))


QUERIES = {
    "se_best_targets": _best,
    "se_repeated": _repeated,
    "se_listed": _listed,
    "se_suitability": _suitability,
    "se_chosen": _chosen,
    "se_shaped": _shaped,
    "se_support": _support,
    "se_primary": _primary,
    "se_entities_in_order": lambda s, d: selection.entities_in_order(catalogue.scored(s, d)),
}


def _texts(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _any(s: str, words) -> str:
    return f"(len(list_filter({_texts(words)}, lambda w: contains({s}, w))) > 0)"


def _of(number: str, values) -> str:
    return f"({_texts(values)})[{number} + 1]"


_capitals = lambda s: f"(len(list_filter(string_split({s}, ' '), lambda w: regexp_matches(w, '^[A-Z]'))) >= 2)"
_SQL_NAME = f"""case p_partkey % 8 when 2 then (1400 + p_partkey % 800)::varchar when 6 then own when 7 then 'City of ' || p_name else {_of('p_partkey % 8', ['' if x is None else x for x in NAMES])} end"""



def type_sql(kind: str) -> str:
    """The score of c for a kind of answer; n is its lower case, low the words of that, nw their number, person whether it
    looks like one, work whether it names a work."""
    has = lambda words: f"list_has_any(low, {_texts(words)})"
    return f"""case when {_any('n', candidates.NEVER)} or list_contains({_texts(candidates.TOO_GENERAL)}, n) then -6
  when {kind} = 'person' then case when work then -5 when person then 4 when list_contains({_texts(candidates.GENERAL_WORDS)}, n) then -4 else -2 end
  when {kind} in {candidates.PLACES} then case when {has(candidates.PLACE_WORDS)} then 4 when work then -5 when regexp_matches(c, '[0-9]') then -4 when person then -3 when regexp_matches(c, '^[A-Z]') then 2 else -1 end
  when {kind} = 'temporal' then case when regexp_matches(c, '^[0-9]{{4}}$') then 3 else -1 end
  when {kind} = 'language' then case when {has(candidates.EVENTS)} then -6 when list_contains(low, 'language') or (nw <= 2 and {has(candidates.LANGUAGES)}) then 5 else -3 end
  when {kind} = 'role' then case when work then -5 when {has(('county', 'city', 'state', 'country'))} then -4 when {has(candidates.ROLE_WORDS)} then 5 else -2 end
  else 0 end"""


def described(c: str) -> str:
    """What type_sql reads of c."""
    return f"lower({c}) n, string_split(lower({c}), ' ') low, len(string_split({c}, ' ')) nw, {_capitals(c)} person, {_any(f'lower({c})', candidates.WORKS)} work"


def suitability_sql(rel: str, natural: str, place: str) -> str:
    """Scores of parts' names; rel, natural and place are SQL for the relation, whether there is the natural answer
    `english`, and the place among candidates."""
    return f"""with own as (select *, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') own from part),
a as (select p_partkey, own, {_SQL_NAME} c, {_of('p_partkey % 7', ASKED)} q, {_of('p_partkey % 7', KINDS)} kind, {rel} rel, p_size % 2 = 1 known, {natural} as natural_known, p_size % 8 < 4 as two, {place} as place from own),
b as (select *, kind in {candidates.PLACES} placed, {described('c')} from a),
t as (select *, {type_sql('kind')} ty from b),
m as (select *, ty + case when list_contains({_texts(candidates.GENERAL_WORDS)}, n) then -2 else 0 end
  + case when placed and rel = 'place.country' or kind = 'person' and rel = 'person.author' or kind = 'role' and rel = 'profession.office' then 1 else 0 end
  + case when kind = 'language' and {_any('n', suitability.SPOKEN_NAMES)} then 3 else 0 end + case when placed and nw <= 3 then 2 else 0 end + case when kind = 'role' and {_any('n', suitability.WORK_NAMES)} then 2 else 0 end as me,
  case when not known then 0 when n = lower(own) then -10 when contains(n, lower(own)) or contains(lower(own), n) then -4
    else greatest(-10, -abs(nw - len(string_split(own, ' '))) + case when kind = 'person' and person and {_capitals('own')} then 3 when placed and not person and not {_capitals('own')} then 2 when kind = 'role' and list_has_any(low, string_split(lower(own), ' ')) then 2 else 0 end) end sh,
  case when placed and rel = 'place.country' or kind = 'person' and rel = 'person.author' then 2 when placed and rel = 'profession.office' then -3 when kind = 'role' and rel = 'profession.office' then 4 else 0 end fit,
  case when kind = 'temporal' and regexp_matches(c, '^(1[5-9]|20)') then c when kind = 'language' and n = 'english' then 'English language' else c end as spelled from t)
select p_partkey, kind, ty as type_score, ty >= case when kind = 'open' then 0 else 2 end and case when kind = 'person' then person when placed then not person and not work else true end as type_fits, me as meaning,
  not (list_contains({_texts(candidates.TOO_GENERAL)}, n) or placed and {_any('n', suitability.NO_PLACES)} or kind = 'person' and not person) as plausible, sh::int as shape, sh >= case when kind = 'open' then -1 else -2 end as shape_fits,
  (3 * sh + 2 * me + greatest(0, 8 - place) + case when natural_known and n <> 'english' then 5 else 0 end + case when length(c) between 2 and 24 then 2 else 0 end + case when nw <= 3 then 2 else 0 end + 1
    + case when regexp_matches(c, '^[0-9]{{4}}$') then 3 else 0 end - case when kind <> 'temporal' and regexp_matches(c, '[0-9]') then 2 else 0 end - case when list_contains({_texts(candidates.TOO_GENERAL)}, n) then 8 else 0 end
    + case when kind = 'person' and person or placed and not person or kind = 'language' and nw <= 2 then 2 else 0 end)::int as choice,
  spelled, case when kind = 'language' and n = 'french language' then c || '|French|x' when spelled <> c then c || '|' || spelled || '|x' else c || '|x' end as spellings,
  fit + case when rel = 'place.country' or two and rel = 'person.author' then 5 when rel = 'type.object.type' then -9 else 0 end as support,
  fit + case when placed and rel = 'place.country' or kind = 'person' and rel = 'person.author' or kind = 'role' and rel = 'profession.office' then 5 when rel = 'type.object.type' then -6 else 0 end as direct,
  'm.piv_' || left(regexp_replace(replace(n, ' ', '_') || '_' || rel || '_' || case when two then 'person.author' else 'bridge' end, '[^a-z0-9_]+', '_', 'g') || '__t__1', 64) as bridge,
  round(least(1.2, greatest(0, place - 2) * 0.18), 6)::double as boost, case when p_partkey % 8 = 6 then ' ' else '' end || c || case when known and (c <> own or p_partkey % 8 = 6) then '|' || own else '' end as known from m"""
_WAYS = " union all ".join(f"select {i} pos, {'null' if x[0] is None else repr(x[0])}::varchar name, '{way}' way, {k} k" for i, x in enumerate(OFFERED) for k in (0, 1) for way in x[1 + k].split())
SUITABILITY = suitability_sql(_of("p_size % 4", RELATIONS), "p_size % 5 > 0", "p_size % 10")
BEST = f"""with j as ({suitability_sql("'type.object.type'", "false", "0")}),
k as (select p_partkey // 8 sample_id, p_partkey % 8 pos, ltrim(split_part(spellings, '|', 1)) entity, choice + greatest(case when kind in ('location', 'country') then 2 else 0 end + case when lower(split_part(spellings, '|', 1)) <> 'english' then 5 else 0 end, case when kind = 'person' then 2 else 0 end) best, kind <> 'open' and type_fits sure from j),
z as (select *, case when sample_id % 5 > 0 then best else 0 end + case when sure then 4 else 0 end + case when pos = 1 then 12 else 0 end as score from k)
select sample_id, (row_number() over (partition by sample_id order by score desc, pos = 1 desc, pos))::int as place, entity, score::int as score from z qualify place <= 3"""
ORACLES = {
    "se_best_targets": BEST,
    "se_repeated": f"with {catalogue.HOME}, n as (select *, unnest(range(1, greatest(1, case when sample_id % 2 = 0 then 3 else 0 end + case when sample_id % 3 = 0 then 2 else 0 end + (sample_id % 5 = 0)::int) + 1)) k from home) select sample_id, sample_id % 2 = 0 as is_primary, 0 as pos, k::int as round, 0 as i, c_name as h, 'in' as r, n_name as t from n union all select sample_id, sample_id % 2 = 0, 0, k::int, 1, n_name, 'in', r_name from n",
    "se_listed": "select n_nationkey, case when n_nationkey % 7 < 5 then n_name || '|x' else '-' end as targets from nation",
    "se_suitability": SUITABILITY,
    "se_chosen": f"with {catalogue.HOME}, ways as ({_WAYS}) select sample_id, way, pos::int as pos, coalesce(name, case pos when 0 then c_name else n_name end) as entity from home join ways on sample_id % 2 = k",
    "se_shaped": f"with {catalogue.HOME} select sample_id, unnest(case when sample_id % 2 = 1 then ['a b c d e'] when contains(r_name, ' ') then ['one two three', 'x y'] else ['x y'] end) as entity from home",
    "se_support": catalogue._sql("select sample_id, 1 as place, h, r, t from triples where r = 'place.region' union all select sample_id, (1 + row_number() over (partition by sample_id order by triple_id))::int as place, h, r, t from triples where r = 'order.placed' qualify place <= 3"),
    "se_primary": f"""with {catalogue.HOME} select sample_id, x.p as is_primary, x.k::int as place, x.h, x.r, x.t from (select sample_id, unnest([
  {{'p': true, 'k': 1, 'h': c_name, 'r': 'in', 't': n_name}}, {{'p': true, 'k': 2, 'h': n_name, 'r': 'in', 't': r_name}}, {{'p': true, 'k': 3, 'h': c_name, 'r': 'in', 't': r_name}},
  {{'p': false, 'k': 1, 'h': r_name, 'r': 'has', 't': n_name}}, {{'p': false, 'k': 2, 'h': c_name, 'r': 'in', 't': 'Atlantis'}}, {{'p': false, 'k': 3, 'h': c_name, 'r': 'in', 't': n_name}}]) x from home)""",
    "se_entities_in_order": catalogue._sql("select sample_id, (row_number() over (partition by sample_id order by side, id))::int as place, entity from (select sample_id, entity, min(side) side, arg_min(id, side * 1000000000 + id) id from (select sample_id, 0 side, triple_id::bigint id, h entity from triples union all select sample_id, 1, triple_id, t from triples) group by all)".replace("group by all", "group by sample_id, entity")),
}
