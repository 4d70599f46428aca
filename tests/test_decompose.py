import pytest
from pyspark.sql import functions as F

from lattica.functions import questions
from lattica.operators import decompose


CASES = [
    ("who wrote Ulysses", [("who wrote Ulysses?", "none")]),
    ("what country is home of people that speak Dutch?", [("what country is home of people?", "none"), ("Which is home of people of [B] is associated with speak Dutch?", "coref")]),
    ("what nation is home of Ann that contains a lake", [("what nation is home of Ann?", "none"), ("Which is home of Ann of [B] contains a lake?", "coref")]),
    ("where was the king born and then where did he die", [("where was the king born?", "none"), ("where did [B] die?", "coref")]),
    ("who died before", [("who died before?", "none")]),
    ("what did Polk do before he was president", [("what did Polk do before he was president?", "none")]),
    ("what is your name that you have", [("what is your name that you have?", "none")]),
    ("  ", []),
    (None, []),
]


def test_steps(spark):
    rows = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(CASES)], "id int, question string")
    got = {}
    for r in decompose.steps(rows).orderBy("parent_id", "sub_id").collect():
        got.setdefault(int(r.parent_id), []).append((r.question, r.dep_type))
        assert (r.id, r.dep_prev_sub_id, r.needs_prev_answer) == ((r.parent_id, None, False) if r.sub_id == 0 else (f"{r.parent_id}_{r.sub_id}", r.sub_id - 1, True))
    assert got == {i: want for i, (_, want) in enumerate(CASES) if want}


@pytest.mark.parametrize(("expr", "given", "want"), [
    (questions.focus, "which film has a big star?", "a big star"),
    (questions.focus, "who is one two three four", "one two three four"),
    (questions.says_little, "what is love?", True),
    (questions.says_little, "what is true love", False),
    (questions.weak, "[B] was here for long?", True),
    (questions.dependency, "and which river in Asia", "filter"),
    (lambda s: questions.with_slot(s, "[C]"), "where is that city?", "where is [C]?"),
    (lambda s: questions.with_slot(s, "[B]"), "the capital?", "the capital of [B]?"),
    (lambda s: questions.about(s, "[B]"), "the school", "Which college did [B] attend?"),
])
def test_parts_of_questions(spark, expr, given, want):
    assert spark.range(1).select(expr(F.lit(given))).first()[0] == want
