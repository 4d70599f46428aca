import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import answers, assembly, metrics, model, prompts, retrieval, targets
from lattica.plans import assembling
from lattica.sources import records

SF = "/root/testdata/sf0.001"
SCORED = "sample_id int, triple_id int, h string, r string, t string, score double"


@pytest.mark.parametrize("name", assembling.ORACLES)
def test_query_equals_sql(spark, same, name):
    same(assembling.QUERIES[name](spark, SF), assembling.ORACLES[name], SF)


def test_recall_counts_what_retrieval_lost(spark):
    """Top 2 of 4 relevant triples; a sample without scored triples doesn't count, equal triples are one."""
    rows = spark.createDataFrame([(1, i, "a", "r", f"b{i}", 1.0 - i / 10) for i in range(6)] + [(1, 9, "a", "r", "b0", 0.0)], SCORED)
    wanted = spark.createDataFrame([(1, "a", "r", f"b{i}") for i in (0, 1, 4, 7)] + [(2, "x", "r", "y")], "sample_id int, h string, r string, t string")
    assert [(r.k, r.recall, r.n_samples) for r in retrieval.triple_recall(retrieval.top_k(rows, 2), wanted, [1, 4]).orderBy("k").collect()] == [(1, 0.25, 1), (4, 0.5, 1)]


def test_random_triples_reach_their_budget(spark):
    graph = spark.createDataFrame([(1, "q", "r", f"b{i}") for i in range(3)] + [(1, f"c{i}", "s", f"d{i}") for i in range(25)] + [(2, "x", "r", "y")], "sample_id int, h string, r string, t string")
    scored = spark.createDataFrame([(1, 0, "q", "r", "b0", 0.9), (1, 1, "c0", "s", "d0", 0.1)], SCORED)
    q = spark.createDataFrame([(1, "q"), (2, "nobody")], "sample_id int, entity string")
    got = retrieval.corrupted(graph, scored, q, 20).collect()
    assert len(got) == 20 == len(set(got)) and {r.h for r in got} == {"q"} and {r.score for r in got} <= {0.9, 0.1}
    every = retrieval.corrupted(graph, scored, q, 1000).collect()
    assert len(every) == 50 and not {r.t for r in every} & {"q", "b0", "b1", "b2"}


def test_metrics_of_forms_and_dependence(spark):
    rows = spark.createDataFrame([(1, ["Paris!", "x"], ["paris"]), (2, ["Москва"], ["москва."]), (3, [" "], ["a"]), (4, ["b"], [" "])], "id int, predictions array<string>, targets array<string>")
    r = metrics.attack_metrics(rows).first()
    assert (r.n, r.a_precision, r.a_hit1, r.a_mrr) == (3, 50.0, round(200 / 3, 6), round(200 / 3, 6))
    steps = spark.createDataFrame([(1, 0, "Who is he?", True, False, True), (1, 1, "", True, True, False), (2, 0, "who is he", False, False, True), (2, 1, "!", False, True, True), (3, 0, "other", False, False, False)], "parent_id int, sub_id int, question string, hit boolean, needs_prev_answer boolean, changed boolean")
    assert tuple(metrics.spread(steps).first()) == (50.0, round(100 / 3, 6), 2, 3)
    assert sorted(map(tuple, metrics.breakpoints(steps).collect())) == [("1", 1), ("none", 2)]
    assert [tuple(x) for x in metrics.chain(steps).collect()] == [(1, 2, 1, 50.0)] and tuple(metrics.dependency_rate(steps).first()) == (2, 50.0)
    assert tuple(metrics.spread(steps.limit(0)).first()) == (0.0, 0.0, 0, 0)


def test_checks_find_what_should_not_be(spark):
    rows = spark.createDataFrame([(1, ["a"], ["a"]), (2, ["a", "b"], ["b", "a"])], "sample_id int, a_entity array<string>, answer array<string>")
    assert [r.sample_id for r in assembly.disagreeing(rows).collect()] == [2]
    some = spark.createDataFrame([(1, 2), (2, 0), (3, 1)], "sample_id int, n_triples int")
    assert [r.sample_id for r in assembly.without_labels(some, some.where("sample_id = 1")).collect()] == [3]
    ids = spark.createDataFrame([("a",)], "id string")
    with pytest.raises(ValueError, match="no evidence for a"):
        prompts.with_evidence(ids, ids.limit(0).selectExpr("id", "array() triples"))
    assert [prompts.prompt_kind(*x) for x in (("gptLabel_x",), ("a", "gpt-4"), ("noevi_0",), ("a", "m", "icl"), ("a", "m", "sys"))] == ["label", "examples", "no_evidence", "examples", "plain"]


def test_debug_and_targets_of_rows(spark):
    rows = spark.createDataFrame([("a", 2, "later"), ("a", 1, ""), ("b", 0, None)], "id string, sub_id int, debug string")
    assert [tuple(r) for r in targets.first_debug(rows).collect()] == [("a", "later")]
    keys = spark.createDataFrame([([], ["C"], ["c", "d "], None), ([], [], [" "], "s"), (None, None, None, None)], "attack_targets array<string>, cascade_poison_targets array<string>, poison_targets array<string>, poison_target string")
    got = keys.select(targets.first_known().alias("f"), targets.all_known().alias("a"), targets.all_known(cascade=False).alias("n")).collect()
    assert [r.x for r in keys.withColumn("attack_targets", F.array(F.lit("z"))).select(targets.all_known(attack=False).alias("x")).collect()] == [["c", "d"], ["s"], []]
    assert [tuple(r) for r in got] == [(["C"], ["C", "c", "d"], ["c", "d"]), ([], ["s"], ["s"]), ([], [], [])]


def test_sinks_and_saved_networks(spark, tmp_path):
    at = str(tmp_path)
    rows = spark.createDataFrame([("x", 1.5, None)], "name string, f1 double, note string").coalesce(1)
    for _ in range(2):
        records.append_summary(rows, f"{at}/summary", ["name", "seed", "f1"])
    table = records.read_table(spark, f"{at}/summary")
    assert table.columns == ["name", "seed", "f1"] and [tuple(r) for r in table.collect()] == [("x", None, "1.5")] * 2
    records.write_details(rows, f"{at}/details")
    assert spark.read.text(f"{at}/details").first().value == '{"name":"x","f1":1.5,"note":null}'
    calls = []
    for _ in range(2):
        assert records.computed_or_read(spark, f"{at}/once", lambda: calls.append(1) or rows).count() == 1
    assert calls == [1]
    net = model.Network(3, 2)
    model.save(spark, net, f"{at}/net")
    back = model.load(spark, f"{at}/net")
    assert (back.width, back.hidden) == (3, 2) and np.array_equal(back.weights, net.weights)


def test_report_and_filters_of_empty_rows(spark):
    rows = assembling.answering.rows(spark, SF)
    assert answers.report(rows).count() == 1
    none = rows.limit(0)
    assert answers.report(none).first().n == 0
