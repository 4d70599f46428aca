import random

import pytest

from lattica.operators import answers
from lattica.plans import answering

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", answering.ORACLES)
def test_query_equals_sql(spark, same, name):
    same(answering.QUERIES[name](spark, SF), answering.ORACLES[name], SF)


def greedy(lines, answers):
    """Longest first, each answer uses up the longest line that holds it."""
    left, n = sorted(lines, key=len, reverse=True), 0
    for a in sorted(dict.fromkeys(answers), key=len, reverse=True):
        hit = next((x for x in left if a in x), None)
        if hit is not None:
            left.remove(hit)
            n += 1
    return n


def test_one_to_one_equals_brute_force(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("bc") for _ in range(rng.randint(1, 3)))
    rows = [(i, "who", "\n".join("ans: " + word() + " " + word() for _ in range(rng.randint(0, 4))), [word() for _ in range(rng.randint(1, 4))]) for i in range(300)]
    got = {r.id: r.n_matched for r in answers.one_to_one(spark.createDataFrame(rows, "id int, question string, prediction string, answers array<string>")).collect()}
    assert got == {i: greedy(list(dict.fromkeys(x.replace(":", "") for x in p.split("\n") if x)), a) for i, _, p, a in rows}


def test_years_and_nulls(spark):
    schema = "id int, question string, prediction string, answers array<string>, answerable boolean, evidence array<string>"
    rows = spark.createDataFrame([(1, "when", "ans: 2010", ["2010-01-01", "2010-05-05"], True, []), (2, "who", None, ["x"], False, ["x"]), (3, "who", "ans: Nonesuch", ["Nonesuch"], True, []), (4, "who", "ans: y", [], False, ["z"])], schema)
    assert [(r.n_matched, r.n_answers, r.no_answer) for r in answers.one_to_one(rows).orderBy("id").collect()] == [(1, 2, False), (0, 1, True), (0, 1, True), (0, 0, False)]
    assert [r.score for r in answers.hallucination(rows).orderBy("id").collect()] == [1.0, 1.0, 0.0, -1.5]
