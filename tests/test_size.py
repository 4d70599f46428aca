"""What queries move between tasks: tables dealt by sample stay where they are."""

import re

import pytest

from lattica.operators import decompose, encoding, graph, planner, retrieval
from lattica.plans import assembling, catalogue, planning, prompting, reasoning, selecting
from lattica.sources import records, runs

D = "/root/testdata/sf0.001"


@pytest.fixture
def moved(spark):
    """How often a plan deals rows by more than their sample."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield lambda df: len(re.findall(r"Exchange hashpartitioning\(sample_id#\d+L?, (?!\d+\))", df._jdf.queryExecution().executedPlan().toString()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_partitions_grow_with_the_input(spark, monkeypatch):
    """Triples of a large input lie in more buckets; a small one takes none away."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = sum(catalogue.table(spark, D, x).count() for x in ("orders", "lineitem"))
    try:
        for n in (6, 2):
            monkeypatch.setattr(records, "ROWS", -(-rows // n))
            lie = catalogue.saved(spark, D).groupBy("sample_id").count().rdd.getNumPartitions()
            assert lie == 6 == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_candidates_move_no_entity(spark, moved):
    assert not re.search(r"Exchange hashpartitioning\(sample_id#\d+L?, rule#", plan(reasoning.QUERIES["kg_rule_candidates"](spark, D)))


def test_only_identifiers_go_back_to_their_samples(spark, moved):
    own = plan(encoding.entities(catalogue.saved(spark, D), catalogue.non_text(spark, D)))
    assert own.index("SortMergeJoin [sample_id#") < own.index("Exchange")


def test_assembly_finds_its_pairs_once(spark):
    assert "l_orderkey" not in plan(assembling._parts(spark, D)[2])


def test_corrupted_moves_no_draw(spark, moved):
    t = catalogue.saved(spark, D)
    own = retrieval.corrupted(t, retrieval.top_k(t, 3).drop("rank"), catalogue.homes(spark, D).selectExpr("sample_id", "c_name entity"), 20)
    assert moved(own) == 0


def test_corrupted_sends_no_draw_to_the_driver(spark, monkeypatch):
    """However small Spark takes the tables for, none of the operator's own is broadcast."""
    t = catalogue.saved(spark, D)
    q = records.dealt(catalogue.homes(spark, D).selectExpr("sample_id", "c_name entity"), records.scratch(spark))
    seen, dealt = [], records.dealt
    monkeypatch.setattr(records, "dealt", lambda df, *x: seen.append(plan(df)) or dealt(df, *x))
    seen.append(plan(retrieval.corrupted(t, retrieval.top_k(t, 3).drop("rank"), q, 20)))
    assert len(seen) == 5 and not any("Broadcast" in x for x in seen)


@pytest.mark.parametrize("changed", [False, True])
def test_order_moves_no_triple(spark, moved, changed):
    assert moved(prompting._ordered(spark, D, changed)) == 0


def test_modes_move_no_line(spark, moved):
    assert moved(prompting.QUERIES["pr_modes"](spark, D)) == 0


def test_chained_moves_no_triple(spark, moved):
    assert moved(planning.QUERIES["pl_chained"](spark, D)) == 0


def test_plan_lies_by_sample(spark):
    """What a pass writes, the next one takes as it lies."""
    samples = spark.createDataFrame([(1, "which one", ["Ann"], ["Bob"])], "sample_id long, question string, q_entities array<string>, answers array<string>")
    graph_ = spark.createDataFrame([(1, 0, "Ann", "has", "Bob", 0.5)], "sample_id long, triple_id int, h string, r string, t string, score double")
    steps = spark.createDataFrame([(1, 0, "which one", None, "none", False)], "sample_id long, sub_id int, question string, dep_prev_sub_id int, dep_type string, needs_prev_answer boolean")
    outcomes, details = planner.plan(samples, graph_, graph_, steps, 1)
    for df in (outcomes, details):
        assert "Exchange" not in df.groupBy("sample_id").count()._jdf.queryExecution().executedPlan().toString()


def test_passes_of_a_plan_meet_by_sample(spark):
    """What is grouped over passes finds each sample in one place."""
    samples = spark.range(20).selectExpr("id sample_id", "'which one' question", "array('Ann') q_entities", "array('Bob') answers")
    graph_ = spark.range(20).selectExpr("id sample_id", "0 triple_id", "'Ann' h", "'has' r", "'Bob' t", "0.5D score")
    steps = spark.range(40).selectExpr("id div 2 sample_id", "int(id % 2) sub_id", "'which one' question", "cast(null as int) dep_prev_sub_id", "'none' dep_type", "false needs_prev_answer")
    seen, inherited = [], planner.inherited
    with pytest.MonkeyPatch.context() as m:
        m.setattr(planner, "inherited", lambda rows: seen.append(rows) or inherited(rows))
        planner.plan(samples, graph_, graph_, steps, 2)
    each = seen[0].groupBy("sample_id").count()
    assert "Exchange" not in each._jdf.queryExecution().executedPlan().toString()
    assert [r["count"] for r in each.collect()] == [2] * 20


def test_labels_move_no_triple(spark, moved):
    t = catalogue.saved(spark, D)
    assert moved(graph.shortest_path_labels(t, catalogue.pairs(spark, D))[0]) == 0


def test_labels_of_several_levels_stand_once(spark):
    """Without broadcasts, a triple that two pairs meet at different levels."""
    t = spark.createDataFrame([(s, i, f"n{i}", f"n{i + 1}") for s in range(20) for i in range(6)], "sample_id long, triple_id int, h string, t string")
    pairs = spark.createDataFrame([(s, "n0", a) for s in range(20) for a in ("n4", "n5", "n6")], "sample_id long, q string, a string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    labels = graph.shortest_path_labels(t, pairs)[0].collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r["sample_id"], r["triple_id"]) for r in labels) == [(s, i) for s in range(20) for i in range(6)]
    assert all(r["label"] == 1 for r in labels)


def test_distances_move_no_node(spark, moved):
    """Names lie by their sample, and kinds of entities aren't looked up, as distances don't use them."""
    own = catalogue.QUERIES["kg_dde"](spark, D)
    assert moved(own) == 0
    assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString()


def test_unions_of_dealt_tables_keep_groups_whole(spark):
    rows = spark.range(50).selectExpr("id sample_id", "id % 3 x")
    one, two = (records.in_rows(records.dealt(records.by(rows), records.scratch(spark)), "sample_id") for _ in range(2))
    both = one.unionByName(two).groupBy("sample_id", "x").count()
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
    assert [r["count"] for r in both.collect()] == [2] * 50


def test_run_deals_its_tables(spark, tmp_path):
    """Also those that a former run left, and parts of a table."""
    rows = spark.range(50).selectExpr("id sample_id", "id % 3 x")
    for computed in (4, 0):
        run = runs.Run(spark, f"file://{tmp_path}")
        run.stage("rows", lambda: rows, key="sample_id")
        parts = run.parted("part", lambda t: t.where("x > 0"), "rows", "sample_id", 2, dealt="sample_id")
        out = run.stage("counts", lambda t: t.groupBy("sample_id", "x").count(), "rows", key="sample_id")
        for df in (parts, out):
            assert "Exchange" not in df.groupBy("sample_id", "x").count()._jdf.queryExecution().executedPlan().toString()
        assert len(run.computed) == computed and out.count() == 50
        twice = parts.unionByName(parts).groupBy("sample_id", "x").count()
        assert sorted(r["sample_id"] for r in twice.where("count = 2").collect()) == [i for i in range(50) if i % 3]


def test_names_of_many_samples_are_looked_up_once(spark):
    t = spark.range(50).selectExpr("id sample_id", "'O#' || id h", "case when id % 2 = 0 then 'x' else 'O#x' end t")
    listed = spark.createDataFrame([("O#x",), ("O#1",)], "entity string")
    rows = lambda often: sorted(encoding.entities(t, listed, often).collect())
    assert rows(2) == rows(1000) == rows(1)
    assert [(r.entity, r.is_text) for r in rows(2) if r.sample_id == 1] == [("O#1", False), ("O#x", False)]


def test_long_expressions_spread(spark):
    one = spark.range(100).selectExpr("id", "'what nation is home of x that contains a lake' question").coalesce(1)
    assert decompose.steps(one).rdd.getNumPartitions() > 1
    assert selecting.parts(spark, D).rdd.getNumPartitions() > 1
