import pytest
from pyspark.sql import functions as F

from lattica.functions import candidates, text


@pytest.mark.parametrize(("name", "kind", "fits"), [
    ("Ann Lee", "person", True), ("ann", "person", False), ("The Film Album", "person", False),
    ("Paris", "city", True), ("Ann Lee", "city", False), ("Paris 2", "city", False), ("male", "country", False),
    ("1984", "temporal", True), ("long ago", "temporal", False),
    ("french", "language", True), ("language", "language", False), ("war of french", "language", False),
    ("Vice President", "role", True), ("County", "role", False),
    ("UTC time zone", "timezone", True), ("x", "timezone", True), ("isbn 1", "open", False), ("anything", "open", True),
])
def test_type_fits(spark, name, kind, fits):
    row = spark.range(1).select(candidates.type_fits(F.lit(name), F.lit(kind)).alias("fits")).first()
    assert row.fits is fits


def test_forms_of_texts(spark):
    one = lambda f, *x: spark.range(1).select(f(*map(F.lit, x)).alias("x")).first().x
    assert one(text.plain, " Été-1: Москва_Ünï!") == "été 1 москва ünï"
    assert [one(text.matches_either, *x) for x in (("Paris, France", "paris"), ("a", "b"), ("!", "b"), ("x", "the X."))] == [True, False, False, True]


def test_kinds_of_questions_and_answers_unknown(spark):
    rows = spark.createDataFrame([("what year was he born", "open"), ("in what year was he born", "temporal"), ("which year", "open"), ("who", "person"), ("What language?", "language"), (None, "open")], "q string, want string")
    assert rows.where(text.answer_type(F.col("q")) != F.col("want")).collect() == []
    none = spark.range(1).select(candidates.shape_similarity(F.lit("Rome"), F.lit(None).cast("array<string>"), F.lit("open")).alias("x")).first().x
    assert none == 0


def test_answers_that_predictions_make(spark):
    rows = spark.createDataFrame([("x\nans: a\nso ans: b ans: c",), ("  whole text ",), ("ans: ",), ("ans: none\n",), (None,)], "p string")
    assert [r.x for r in rows.select(text.made_answers(F.col("p")).alias("x")).collect()] == [["a", "c"], ["whole text"], [], ["ans: none"], []]
