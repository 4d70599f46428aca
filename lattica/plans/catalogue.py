"""Queries of the question-answering operators over the star-schema tables, and their SQL.

A customer is a question: its graph links it to its nation, orders and their parts, the nation to its region. The
question's entity is the customer, its answers are nation and region."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lattica.functions import text
from lattica.operators import encoding, graph, metrics, retrieval
from lattica.sources import records, runs

KS = [1, 5, 10, 50, 100]
#: Triples that retrieval keeps in the recall queries other than kg_run_recall.
MOST = 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("c_custkey").alias("sample_id"), "c_name", "n_name", "r_name")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, triple_id, h, r, t, score."""
    records.together(spark)
    home = homes(spark, sf_dir)
    o, l, p = (table(spark, sf_dir, x) for x in ("orders", "lineitem", "part"))
    records.roomy(spark, o, l)
    col = lambda kind, k1, k2, h, t, s: [F.col("sample_id"), F.lit(kind).alias("kind"), k1.cast("long").alias("k1"), k2.cast("long").alias("k2"), h.cast("string").alias("h"), t.cast("string").alias("t"), s.cast("double").alias("score")]
    zero, none = F.lit(0), F.lit(None)
    placed = home.select("sample_id", "c_name").join(o.select("o_orderkey", "o_custkey", "o_totalprice"), F.col("sample_id") == F.col("o_custkey"))
    # Lines meet their order first, which only customers' orders are left of, and their part last: names are wide.
    own = o.select("o_orderkey", F.col("o_custkey").alias("sample_id")).join(home.select("sample_id"), "sample_id", "left_semi")
    lines = own.join(l.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), F.col("o_orderkey") == F.col("l_orderkey"))
    items = lines.select("sample_id", "o_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").join(p.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    # Names of orders and relations follow from kind and k1, so only the other names go to their sample.
    rows = (
        home.select(col(0, zero, zero, F.col("c_name"), F.col("n_name"), F.lit(0.5)))
        .unionByName(home.select(col(1, zero, zero, F.col("n_name"), F.col("r_name"), F.lit(0.1))))
        .unionByName(placed.select(col(2, F.col("o_orderkey"), zero, F.col("c_name"), none, F.col("o_totalprice") / 1e6)))
        .unionByName(items.select(col(3, F.col("o_orderkey"), F.col("l_linenumber"), none, F.col("p_name"), F.col("l_extendedprice") / 1e6)))
    )
    w = Window.partitionBy("sample_id").orderBy("kind", "k1", "k2", "t", "score")
    kind, name = F.col("kind"), F.concat(F.lit("O#"), F.col("k1").cast("string"))
    relation = F.when(kind == 0, "location.nation").when(kind == 1, "place.region").when(kind == 2, "order.placed").otherwise("order.item")
    return rows.withColumn("triple_id", F.row_number().over(w) - 1).select("sample_id", "triple_id", F.when(kind == 3, name).otherwise(F.col("h")).alias("h"), relation.alias("r"), F.when(kind == 2, name).otherwise(F.col("t")).alias("t"), "score")


def saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored triples as a table dealt by sample, for queries that use them more than once."""
    return records.dealt(scored(spark, sf_dir), records.scratch(spark))


def non_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("O#"), F.col("o_orderkey").cast("string")).alias("entity"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = homes(spark, sf_dir)
    return h.select("sample_id", F.col("c_name").alias("q"), F.explode(F.array("n_name", "r_name")).alias("a"))


def waiting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id of customers that have an order without items; queries take them for samples that lack a partner."""
    o, l = (table(spark, sf_dir, x) for x in ("orders", "lineitem"))
    return o.join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select(F.col("o_custkey").alias("sample_id")).distinct()


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("sample_id", F.col("a").alias("entity"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("sample_id") % 3
    p = F.when(k == 0, F.array("n_name", F.concat(F.lit("The "), "r_name", F.lit("!")))).when(k == 1, F.array("c_name", "n_name")).otherwise(F.array().cast("array<string>"))
    return homes(spark, sf_dir).select(F.col("sample_id").alias("id"), p.alias("predictions"), F.array("r_name", "n_name").alias("answers"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions in two spellings, some without any letter; steps that need an earlier answer, and changed ones."""
    i = F.col("event_id")
    q = F.when(i % 11 == 0, "?!").when(i % 2 == 0, F.concat(F.upper("event_type"), F.lit(" été?"))).otherwise(F.concat(F.lit(" -"), "event_type", F.lit(" Été.")))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("parent_id"), i.alias("sub_id"), q.alias("question"), (F.col("value") > 20).alias("hit"), (i % 3 > 0).alias("needs_prev_answer"), (i % 4 == 0).alias("changed"))


def _gold(t):
    return t.where("r in ('location.nation', 'place.region')").select("sample_id", "triple_id", "h", "r", "t")


def _entities(s, d):
    return encoding.entities(scored(s, d), non_text(s, d))


def _with_gold(s, d):
    t = saved(s, d)
    return retrieval.with_gold(retrieval.top_k(t, 3).drop("rank"), _gold(t))


def _recall(s, d):
    """Recall of shortest-path triples among the first MOST, the others being lost to retrieval."""
    t = saved(s, d)
    labels = graph.shortest_path_labels(t, pairs(s, d))[0].where("label > 0")
    return retrieval.triple_recall(retrieval.top_k(t, MOST), t.join(labels, ["sample_id", "triple_id"]), KS)


def _run_recall(s, d):
    """Recall of shortest-path triples among all ranked ones, from a run of committed stages, whose folder keeps nothing
    else. Stages keep ranks only: triples lie where their own stage put them."""
    run = runs.Run(s, records.scratch(s))
    run.stage("triples", lambda: scored(s, d), tables=d, key="sample_id")
    run.stage("labels", lambda t: graph.shortest_path_labels(t, pairs(s, d))[0].where("label > 0"), "triples", key="sample_id")
    run.parted("ranked", lambda t: retrieval.ranked(t).select("sample_id", "triple_id", "rank"), "triples", "sample_id", 3, dealt="sample_id")
    ranks = lambda *x: functools.reduce(DataFrame.unionByName, (records.in_rows(t, "sample_id") for t in x))
    key = ["sample_id", "triple_id"]
    return run.stage("recall", lambda t, labels, *parts: retrieval.triple_recall(t.join(ranks(*parts), key), t.join(labels, key), KS), "triples", "labels", *(f"ranked/part={i}" for i in range(3)), ks=KS)


def _labelled_recall(s, d):
    """Recall of triples that another source calls relevant, of which the graph doesn't have all, and a question nothing."""
    h = homes(s, d)
    own = h.select("sample_id", F.col("c_name").alias("h"), F.lit("location.nation").alias("r"), F.col("n_name").alias("t"))
    other = h.select("sample_id", F.col("n_name").alias("h"), F.lit("place.capital").alias("r"), F.col("c_name").alias("t"))
    nobody = own.select((-F.col("sample_id")).alias("sample_id"), "h", "r", "t")
    items = scored(s, d).where("r = 'order.item' and triple_id % 5 = 0").select("sample_id", "h", "r", "t")
    return retrieval.triple_recall(retrieval.top_k(scored(s, d), MOST), own.unionByName(other).unionByName(nobody).unionByName(items), KS)


def _corrupted(s, d):
    t = saved(s, d)
    return retrieval.corrupted(t, retrieval.top_k(t, 3).drop("rank"), homes(s, d).select("sample_id", F.col("c_name").alias("entity")), 20)


def _encoded(s, d):
    t = saved(s, d)
    return encoding.encoded(t, encoding.entities(t, non_text(s, d)), encoding.relations(t))


def _dde(s, d):
    t = saved(s, d)
    nodes = encoding.ends(t).join(homes(s, d).select("sample_id", F.col("c_name").alias("entity"), F.lit(1.0).alias("x1")), ["sample_id", "entity"], "left").select("sample_id", F.col("entity").alias("node"), F.coalesce("x1", F.lit(0.0)).alias("x1")).withColumn("x0", 1 - F.col("x1"))
    out = graph.directional_distances(t, nodes)
    return out.select("sample_id", "node", *(F.round(c, 6).alias(c) for c in out.columns if c not in ("sample_id", "node")))


def _attack(s, d):
    """Targets in other spellings; rows without any don't count."""
    own = predictions(s, d)
    targets = F.when(F.col("id") % 7 == 0, F.array(F.lit(" "))).otherwise(F.transform("answers", lambda x: F.concat(F.lit("L’Été-"), F.lower(x))))
    made = F.concat(F.transform("predictions", lambda x: F.concat(F.lit("l été: "), x, F.lit("!"))), F.array(F.lit("  ")))
    return metrics.attack_metrics(own.select("id", made.alias("predictions"), targets.alias("targets")))


def _normal(s, d):
    return table(s, d, "part").select("p_partkey", text.normalize(F.concat(F.lit("The "), "p_name", F.lit(", a "), "p_type")).alias("normal"), text.plain(F.concat("p_brand", F.lit("-Ünï’42…Москва"))).alias("plain"), text.answer_type(F.concat(F.lit("where is the "), "p_name")).alias("kind"))


QUERIES = {
    "kg_triples": scored,
    "kg_entities": _entities,
    "kg_relations": lambda s, d: encoding.relations(scored(s, d)),
    "kg_encoded": _encoded,
    "kg_anchors": lambda s, d: encoding.anchors_in_graph(answers(s, d).withColumn("kind", F.lit("a")), _entities(s, d)),
    "kg_path_labels": lambda s, d: graph.shortest_path_labels(scored(s, d), pairs(s, d))[0],
    "kg_max_path_length": lambda s, d: graph.shortest_path_labels(scored(s, d), pairs(s, d))[1],
    "kg_dde": _dde,
    "kg_paths": lambda s, d: graph.paths(scored(s, d), homes(s, d).select("sample_id", F.col("c_name").alias("node"))).groupBy("sample_id", "r1", "r2").agg(F.count("*").alias("n"), F.count_distinct("target").alias("targets")),
    "kg_top_k": lambda s, d: retrieval.top_k(scored(s, d), 20).select("sample_id", "triple_id", "rank"),
    "kg_recall_at_k": _recall,
    "kg_run_recall": _run_recall,
    "kg_labelled_recall": _labelled_recall,
    "kg_answer_recall": lambda s, d: retrieval.answer_recall(retrieval.top_k(scored(s, d), MOST), answers(s, d), KS),
    "kg_score_map": lambda s, d: retrieval.score_map(scored(s, d)),
    "kg_one_per_pair": lambda s, d: retrieval.one_per_pair(retrieval.ranked(scored(s, d))).select("sample_id", "triple_id", "rank"),
    "kg_without_answers": lambda s, d: retrieval.without_answers(scored(s, d), answers(s, d)).groupBy("sample_id").agg(F.count("*").alias("n")),
    "kg_with_gold": _with_gold,
    "kg_corrupted": _corrupted,
    "kg_answer_scores": lambda s, d: metrics.answer_scores(predictions(s, d)).select("id", "hit", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1"))),
    "kg_answer_summary": lambda s, d: metrics.summary(metrics.answer_scores(predictions(s, d))),
    "kg_attack_metrics": _attack,
    "kg_spread": lambda s, d: metrics.spread(steps(s, d)),
    "kg_dependency_rate": lambda s, d: metrics.dependency_rate(steps(s, d)),
    "kg_chain": lambda s, d: metrics.chain(steps(s, d)),
    "kg_breakpoints": lambda s, d: metrics.breakpoints(steps(s, d)),
    "kg_normalize": _normal,
}

HOME = "home as (select c_custkey sample_id, c_name, n_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"
TRIPLES = f"""{HOME},
raw as (select sample_id, 0 kind, 0 k1, 0 k2, c_name h, 'location.nation' r, n_name t, 0.5::double score from home
  union all select sample_id, 1, 0, 0, n_name, 'place.region', r_name, 0.1::double from home
  union all select sample_id, 2, o_orderkey, 0, c_name, 'order.placed', 'O#' || o_orderkey, o_totalprice / 1e6 from home join orders on o_custkey = sample_id
  union all select sample_id, 3, o_orderkey, l_linenumber, 'O#' || o_orderkey, 'order.item', p_name, l_extendedprice / 1e6 from home join orders on o_custkey = sample_id join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey),
triples as materialized (select sample_id, (row_number() over (partition by sample_id order by kind, k1, k2, t, score) - 1)::int triple_id, h, r, t, score from raw),
ranked as (select *, row_number() over (partition by sample_id order by score desc, triple_id)::int rank from triples),
ends as (select distinct sample_id, entity from (select sample_id, h entity from triples union all select sample_id, t from triples)),
ids as materialized (select sample_id, entity, (row_number() over (partition by sample_id order by entity like 'O#%', entity) - 1)::int entity_id, entity not like 'O#%' is_text from ends),
rels as (select sample_id, relation, (row_number() over (partition by sample_id order by relation) - 1)::int relation_id from (select distinct sample_id, r relation from triples)),
answers as (select sample_id, unnest([n_name, r_name]) entity from home),
pairs as (select sample_id, c_name q, unnest([n_name, r_name]) a from home),
preds as (select sample_id id, case sample_id % 3 when 0 then [n_name, 'The ' || r_name || '!'] when 1 then [c_name, n_name] else []::varchar[] end predictions, [r_name, n_name] answers from home),
steps as (select user_id parent_id, event_id sub_id, case when event_id % 11 = 0 then '?!' when event_id % 2 = 0 then upper(event_type) || ' été?' else ' -' || event_type || ' Été.' end question, value > 20 hit, event_id % 3 > 0 needs, event_id % 4 = 0 changed from events),
dep as (select parent_id, hit, row_number() over (partition by parent_id order by sub_id)::int k from steps where needs)"""
PLAIN = lambda x: f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
#: No edge leads back, so the only shortest paths are the one to the nation and its continuation to the region.
LABELS = "labels as (select sample_id, triple_id, case when r in ('location.nation', 'place.region') then 1.0::double else 0.0::double end as label from triples)"
NORMAL = lambda x: f"trim(regexp_replace(regexp_replace(translate(lower({x}), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', ''), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"


#: The customers of waiting().
WAITING = "(select o_custkey from orders anti join lineitem on o_orderkey = l_orderkey)"


def _sql(body: str, more: str = "") -> str:
    return f"with {TRIPLES}{', ' + more if more else ''} {body}"


def _mean(name: str, of: str, a: str, b: str) -> str:
    return f"{name}m as (select x.sample_id, {b} node, avg(y0) y0, avg(y1) y1 from triples x join {of} y on x.sample_id = y.sample_id and {a} = y.node group by 1, 2), {name} as (select n.sample_id, n.node, coalesce(m.y0, 0.0) y0, coalesce(m.y1, 0.0) y1 from n0 n left join {name}m m on n.sample_id = m.sample_id and n.node = m.node)"


DDE = "n0 as (select e.sample_id, e.entity node, case when e.entity = c_name then 0.0 else 1.0 end::double y0, case when e.entity = c_name then 1.0 else 0.0 end::double y1 from ids e join home using (sample_id)), " + ", ".join([_mean("f1", "n0", "h", "t"), _mean("f2", "f1", "h", "t"), _mean("b1", "n0", "t", "h"), _mean("b2", "b1", "t", "h")])
_recall = lambda each: " union all ".join(f"select {k} as k, round(avg(k{k}), 6) as recall, count(*) as n_samples from ({each})" for k in KS)
_recalled = lambda wanted, most=f" where rank <= {MOST}": _recall("select sample_id, " + ", ".join(f"avg(coalesce((rank <= {k})::int, 0)) k{k}" for k in KS) + f" from (select distinct sample_id, h, r, t from ({wanted})) left join (select sample_id, h, r, t, min(rank) rank from ranked{most} group by all) using (sample_id, h, r, t) where sample_id in (select sample_id from triples) group by 1")
#: Only triples of the customer touch it, always as head. The whole product stands behind the draws here.
_number = lambda what: f"(('0x' || md5(concat_ws('|', '0', sample_id, k, '{what}'))[1:15])::bigint)"


def corrupted_sql(budget: int) -> str:
    """made: sample_id, h, r, t, score, n of the random triples, n from 1 in their order."""
    return f"""least3 as (select sample_id, min(score) least from ranked where rank <= 3 group by 1),
sources as (select *, row_number() over (partition by sample_id order by h, r, t) - 1 s, count(*) over (partition by sample_id) n_s from (select t.sample_id, t.h, t.r, t.t, coalesce(max(x.score), any_value(least)) score from (select distinct sample_id, h, r, t from triples join home using (sample_id) where h = c_name) t join least3 using (sample_id) left join ranked x on x.rank <= 3 and x.sample_id = t.sample_id and x.h = t.h and x.r = t.r and x.t = t.t group by 1, 2, 3, 4)),
pool as (select *, row_number() over (partition by sample_id order by entity) - 1 e, count(*) over (partition by sample_id) n_e from ends),
picks as (select sample_id, 0 stage, k, {_number('source')} % n_s s, {_number('entity')} % n_e e from (select distinct sample_id, n_s, n_e from sources join pool using (sample_id)), range({retrieval.DRAWS * budget}) g(k)
  union all select sample_id, 1, s * n_e + e, s, e from sources join pool using (sample_id)),
first as (select sample_id, h, r, entity t, min((stage, k, score)) best from picks join sources using (sample_id, s) join pool using (sample_id, e) where entity <> h group by 1, 2, 3, 4),
made as (select sample_id, h, r, t, best[3] score, row_number() over (partition by sample_id order by best[1], best[2]) n from first m where not exists (select 1 from triples x where x.sample_id = m.sample_id and x.h = m.h and x.r = m.r and x.t = m.t) qualify n <= {budget})"""


NUMBERED = """named as materialized (select t.*, relation_id r_id from triples t join rels r on r.sample_id = t.sample_id and r.relation = t.r),
numbered as materialized (select n.*, entity_id h_id from named n join ids a on a.sample_id = n.sample_id and a.entity = n.h)"""
_scores = f"""sc as (select id, answers, predictions, len(list_filter(predictions, lambda x: len(list_filter(answers, lambda y: contains({NORMAL('x')}, {NORMAL('y')}))) > 0)) good, len(list_filter(answers, lambda y: len(list_filter(predictions, lambda x: contains({NORMAL('x')}, {NORMAL('y')}))) > 0)) found from preds),
sp as (select id, (found > 0)::int hit, case when len(predictions) > 0 then good / len(predictions) else 0.0 end::double p, (found / len(answers))::double r from sc),
sf as (select *, case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end::double f from sp)"""
ORACLES = {
    "kg_triples": _sql("select * from triples"),
    "kg_entities": _sql("select * from ids"),
    "kg_relations": _sql("select * from rels"),
    "kg_encoded": _sql("select n.sample_id, triple_id, h_id, r_id, b.entity_id as t_id from numbered n join ids b on b.sample_id = n.sample_id and b.entity = n.t", NUMBERED),
    "kg_anchors": _sql("select sample_id, entity, 'a' as kind, entity_id from answers join ids using (sample_id, entity)"),
    "kg_path_labels": _sql("select * from labels", LABELS),
    "kg_max_path_length": _sql("select sample_id, 2 as max_path_length from home"),
    "kg_dde": _sql("select n0.sample_id, n0.node, n0.y1 as x1, n0.y0 as x0, " + ", ".join(f"round({x}.y{i}, 6) as {x}_{i}" for x in ("f1", "f2", "b1", "b2") for i in (0, 1)) + " from n0 " + " ".join(f"join {x} on {x}.sample_id = n0.sample_id and {x}.node = n0.node" for x in ("f1", "f2", "b1", "b2")), DDE),
    "kg_paths": _sql("select sample_id, r1, r2, count(*) as n, count(distinct target) as targets from (select t.sample_id, t.r r1, null::varchar r2, t.t target from triples t join home on home.sample_id = t.sample_id and h = c_name union all select t.sample_id, t.r, u.r, u.t from triples t join home on home.sample_id = t.sample_id and t.h = c_name join triples u on u.sample_id = t.sample_id and u.h = t.t) group by all"),
    "kg_top_k": _sql("select sample_id, triple_id, rank from ranked where rank <= 20"),
    "kg_recall_at_k": _sql(_recalled("select sample_id, h, r, t from labels join triples using (sample_id, triple_id) where label > 0"), LABELS),
    "kg_run_recall": _sql(_recalled("select sample_id, h, r, t from labels join triples using (sample_id, triple_id) where label > 0", ""), LABELS),
    "kg_labelled_recall": _sql(_recalled("select sample_id, c_name h, 'location.nation' r, n_name t from home union all select sample_id, n_name, 'place.capital', c_name from home union all select -sample_id, c_name, 'location.nation', n_name from home union all select sample_id, h, r, t from triples where r = 'order.item' and triple_id % 5 = 0")),
    "kg_answer_recall": _sql(_recall("select sample_id, " + ", ".join(f"avg(coalesce((rank <= {k})::int, 0)) k{k}" for k in KS) + f" from answers left join (select sample_id, entity, min(rank) rank from (select sample_id, h entity, rank from ranked where rank <= {MOST} union all select sample_id, t, rank from ranked where rank <= {MOST}) group by 1, 2) using (sample_id, entity) where sample_id in (select sample_id from triples) group by 1")),
    "kg_score_map": _sql("select sample_id, h, r, t, max(score) as score from triples group by all"),
    "kg_one_per_pair": _sql("select sample_id, triple_id, rank from ranked qualify row_number() over (partition by sample_id, least(h, t), greatest(h, t) order by rank) = 1"),
    "kg_without_answers": _sql("select t.sample_id, count(*) as n from triples t join home using (sample_id) where not (contains(h, n_name) or contains(t.t, n_name) or contains(h, r_name) or contains(t.t, r_name)) group by 1"),
    "kg_with_gold": _sql("select sample_id, h, r, t, case when rank <= 3 then rank else -triple_id - 1 end::bigint as pos from ranked where rank <= 3 or r in ('location.nation', 'place.region')"),
    "kg_corrupted": _sql("select sample_id, h, r, t, score from made", corrupted_sql(20)),
    "kg_answer_scores": _sql("select id, hit, round(p, 6) as precision, round(r, 6) as recall, round(f, 6) as f1 from sf", _scores),
    "kg_answer_summary": _sql("select count(*) as n, round(100 * avg(hit), 6) as hit, round(100 * avg(p), 6) as precision, round(100 * avg(r), 6) as recall, round(100 * avg(f), 6) as f1, round(100 * avg((f = 1)::int), 6) as exact, round(100 * avg((r = 0)::int), 6) as wrong from sf", _scores),
    "kg_attack_metrics": _sql("select count(*) as n, round(100 * avg(coalesce(len(list_filter(h, lambda x: x)) / nullif(len(h), 0), 0)), 6) as a_precision, round(100 * avg(coalesce(h[1], false)::int), 6) as a_hit1, round(100 * avg(coalesce(1 / nullif(list_position(h, true), 0), 0)), 6) as a_mrr from (select list_transform(predictions, lambda x: list_contains(list_transform(answers, lambda y: lower(y)), lower(x))) h from preds where id % 7 <> 0)"),
    "kg_spread": _sql("select round(coalesce(100 * h / nullif(n, 0), 0), 6) as shared_parent_spread_rate, round(100 * hits / parents, 6) as overall_parent_spread_rate, n::bigint as shared_parent_total, parents as overall_parent_total from (select coalesce(sum(p), 0) n, coalesce(sum(h), 0) h from (select replace(replace(lower(question), ' -', ''), '?', '.') q, count(distinct parent_id) p, count(distinct case when hit then parent_id end) h from steps where question <> '?!' group by 1) where p > 1), (select count(distinct parent_id) parents, count(distinct case when hit and changed then parent_id end) hits from steps)"),
    "kg_dependency_rate": _sql("select count(*) as n, round(100 * avg(hit::int), 6) as dependency_asr from steps where needs"),
    "kg_chain": _sql("select k, count(*) as chains, sum(a)::bigint as successes, round(100 * sum(a) / count(*), 6) as chain_success from (select k, min(hit::int) over (partition by parent_id order by k rows unbounded preceding) a from dep) group by 1"),
    "kg_breakpoints": _sql("select coalesce(k::varchar, 'none') as breakpoint, count(*) as chains from (select distinct parent_id from steps) left join (select parent_id, min(case when not hit then k end) k from dep group by 1) using (parent_id) group by 1"),
    "kg_normalize": f"select p_partkey, {NORMAL(chr(39) + 'The ' + chr(39) + ' || p_name || ' + chr(39) + ', a ' + chr(39) + ' || p_type')} as normal, replace(lower(p_brand), '#', ' ') || ' ünï 42 москва' as plain, 'location' as kind from part",
}
