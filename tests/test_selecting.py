import pytest
from pyspark.sql import functions as F

from lattica.functions import suitability
from lattica.operators import selection
from lattica.plans import selecting

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", selecting.QUERIES)
def test_query_equals_sql(spark, same, name):
    same(selecting.QUERIES[name](spark, SF), selecting.ORACLES[name], SF)


def test_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, 0, None, "where", "a", None), (1, 1, "Paris", None, None, None)], "sample_id int, pos int, entity string, question string, r1 string, r2 string")
    blocked = spark.createDataFrame([(1, None), (1, " ")], "sample_id int, entity string")
    for way in ("pivot", "between", "soft", "final", "rule", "global"):
        assert [r.entity for r in selection.chosen(rows, blocked, way).collect()] == ["Paris"]
        assert selection.chosen(rows.limit(0), blocked.limit(0), way).count() == 0
    with pytest.raises(ValueError):
        selection.chosen(rows, blocked, "other")


def test_names_of_nodes_between(spark):
    one = lambda *x: spark.range(1).select(suitability.bridge_name(*(F.lit(v).cast("string") for v in x)).alias("x")).first().x
    assert one("Ann Lee", "B-C", "a.b", None) == "m.piv_ann_lee_a_b_bridge_b_c"
    assert one("É x", "a", "b", "") == "m.piv_x_b_bridge_a" and one("a É b", "c", "d", "") == "m.piv_a___b_d_bridge_c"
    assert one("", "?", "", "!") == "m.piv_bridge" and len(one("x" * 99, "y", "r", "s")) == 70


def test_replies_that_list_nothing(spark):
    rows = spark.createDataFrame([(None,), ("",), ("{broken",), ("[1, 2",), ('{"answers": "x"}',), ('{"other": ["a"]}',), ('{"targets": [1, "b"]}',)], "reply string")
    assert [r.x for r in rows.select(suitability.listed(F.col("reply")).alias("x")).collect()] == [None, None, None, None, None, ["a"], ["1", "b"]]


def test_best_targets_without_candidates_or_paths(spark):
    rows = spark.createDataFrame([(1, 0, " Rome ", "where?", [], False), (1, 1, "rome", "where?", [], True), (1, 2, " ", "where?", [], False)], "sample_id int, pos int, entity string, question string, answers array<string>, inherited boolean")
    paths = spark.createDataFrame([], "sample_id int, r1 string, r2 string, natural string")
    assert [(r.place, r.entity, r.score) for r in selection.best_targets(rows, paths, 5).collect()] == [(1, "rome", 12)]
    assert selection.best_targets(rows.limit(0), paths, 5).count() == 0
