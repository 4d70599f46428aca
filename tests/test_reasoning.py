import pytest
from pyspark.sql import functions as F

from lattica.functions import candidates
from lattica.plans import reasoning

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", reasoning.ORACLES)
def test_query_equals_sql(spark, same, name):
    same(reasoning.QUERIES[name](spark, SF), reasoning.ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(reasoning.QUERIES) - set(reasoning.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert not reasoning.QUERIES[name](spark, SF).isEmpty()


def test_type_scores(spark):
    cases = [("Ann Lee", "person", 4), ("writer", "person", -4), ("a film", "person", -5), ("m.0abc", "open", -6), ("Lake Ohrid", "city", 4), ("Ann Lee", "city", -3), ("Paris", "city", 2), ("May 1999", "temporal", 3), ("Old Dutch", "language", 5), ("Dutch war", "language", -6), ("language", "language", -6), ("vice president", "role", 5), ("time", "timezone", 3), ("x", "open", 0)]
    rows = spark.createDataFrame(cases, "c string, kind string, want int")
    assert rows.where(candidates.type_score(F.col("c"), F.col("kind")) != F.col("want")).collect() == []


def test_shapes_and_surfaces(spark):
    rows = spark.createDataFrame([("Ann Lee", ["Bob Ray"], "person", 3), ("Ann Lee", ["ann lee"], "person", -10), ("Ann", ["Ann Lee"], "person", -4), ("Rome", [], "city", 0), ("Rome", ["Paris on Seine"], "city", -2), ("Rome", [" "], "city", -10)], "c string, a array<string>, kind string, want int")
    got = rows.select("want", candidates.shape_similarity(F.col("c"), F.col("a"), F.col("kind")).alias("got")).collect()
    assert [r.got for r in got] == [3, -10, -4, 0, -2, -10]
    names = spark.createDataFrame([("Rome", True), ("m.piv_x", True), ("m.12", False), ("--- !", False), ("ab", False), ("[x y]", False), (None, False)], "c string, want boolean")
    assert names.where(candidates.surface_ok(F.col("c")) != F.col("want")).collect() == []
