import pytest

from lattica.operators import prompts
from lattica.plans import prompting

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", prompting.ORACLES)
def test_query_equals_sql(spark, same, name):
    same(prompting.QUERIES[name](spark, SF), prompting.ORACLES[name], SF)


def test_shuffled_is_a_permutation(spark):
    got = prompting.QUERIES["pr_shuffled"](spark, SF)
    old = prompting.scored(spark, SF).select("sample_id", "h", "r", "t").distinct()
    assert got.drop("rank").exceptAll(old).isEmpty() and old.exceptAll(got.drop("rank")).isEmpty()


def test_unreached_and_blank_ends_come_last(spark):
    t = spark.createDataFrame([(1, 0, "x", "r", "y", 0.9), (1, 1, "Q", "r", " ", 0.1), (1, 2, "", "r", "z", 0.8)], "sample_id int, pos int, h string, r string, t string, score double")
    marks = spark.createDataFrame([(1, "q", "q")], "sample_id int, kind string, value string")
    sets = spark.createDataFrame([], "sample_id int, kind string, pos int, h string, r string, t string")
    assert [(r.h, r.priority, r.bucket) for r in prompts.ordered(t, marks, sets).orderBy("rank").collect()] == [("Q", 3, "neighbor"), ("x", 2, "filler"), ("", 1, "filler")]


def test_prompt_without_evidence(spark):
    q = spark.createDataFrame([(1, "where?"), (2, "who")], "sample_id int, question string")
    assert [r.user_query for r in prompts.rendered(q, None).orderBy("sample_id").collect()] == ["Question:\nwhere?", "Question:\nwho?"]


def test_modes_by_name(spark):
    assert prompts.mode_of("scored_100_rev_firstq_gt") == prompts.Mode("scored", 100, reverse=True, question_first=True, relevant=True)
    assert prompts.mode_of("randNoA_7") == prompts.Mode("random", 7, no_answers=True)
    assert prompts.mode_of("rog_50_rmht_rev") == prompts.Mode("paths", 50, one_per_pair=True)
    assert prompts.mode_of("noevi") == prompts.Mode("none")
    q = spark.createDataFrame([(1, "where?"), (2, "who")], "sample_id int, question string")
    with pytest.raises(ValueError, match="no such mode: best_5"):
        prompts.by_mode("best_5", q)
    with pytest.raises(ValueError, match="randNoA_5 needs triples, answers"):
        prompts.by_mode("randNoA_5", q)
    t = spark.createDataFrame([(1, 1, "q", "r", "x", 0.9), (1, 2, "q", "r", "y", 0.5), (1, 3, "q", "r", "z", 0.0)], "sample_id int, pos int, h string, r string, t string, score double")
    marks = spark.createDataFrame([(1, "q", "q")], "sample_id int, kind string, value string")
    sets = spark.createDataFrame([], "sample_id int, kind string, pos int, h string, r string, t string")
    shown = lambda mode, threshold: [r.user_query for r in prompts.by_mode(mode, q, t, marks, sets, threshold=threshold).orderBy("sample_id").collect()]
    assert shown("scored_2_rev", 0) == ["Triplets:\n(q,r,y)\n(q,r,x)\n\nQuestion:\nwhere?", "Triplets:\n\n\nQuestion:\nwho?"]
    assert shown("scored_2_firstq", 0.6)[0] == "Question:\nwhere?\n\nTriplets:\n(q,r,x)"


def test_equal_lines_and_pairs_once(spark):
    """Triples that differ but read alike count once; with rmht a pair of ends counts once in each list, in either direction."""
    q = spark.createDataFrame([(1, "q?")], "sample_id int, question string")
    cols = "sample_id int, pos int, h string, r string, t string"
    paths = spark.createDataFrame([(1, 0, "a,b", "r", "c"), (1, 1, "c", "s", "a,b")], cols)
    scored = spark.createDataFrame([(1, 1, "a", "b,r", "c"), (1, 2, "c", "u", "a"), (1, 3, "x", "r", "y"), (1, 4, "x", "r", "y")], cols)
    shown = lambda mode: prompts.by_mode(mode, q, scored, paths=paths).first().user_query.split("\n")[1:-3]
    assert shown("rog_9") == ["(a,b,r,c)", "(c,s,a,b)", "(c,u,a)", "(x,r,y)"]
    assert shown("rog_9_rmht") == ["(a,b,r,c)", "(x,r,y)"]
    assert shown("rog_1") == ["(a,b,r,c)"]


def test_loaded(spark):
    rows = spark.createDataFrame([("a", 2, ["x -> r -> y"]), ("b", 1, [])], "id string, pos int, paths array<string>")
    graphs = spark.createDataFrame([("a", []), ("b", ["e"])], "id string, q_entity array<string>")
    known = graphs.limit(0)
    triple = "array<struct<h:string,r:string,t:string,score:double>>"
    evidence = spark.createDataFrame([("a", [("h", "r", "t", 0.5)], [("1", "r", "2"), ("h", "r", "t"), ("3", "r", "4")])], f"id string, scored_triples {triple}, relevant array<struct<h:string,r:string,t:string>>")
    with pytest.raises(ValueError, match="no evidence for b"):
        prompts.loaded(rows, graphs, evidence, known, "scored_5")
    with pytest.raises(ValueError, match="no graph for b"):
        prompts.loaded(rows, graphs.where("id = 'a'"), evidence, known)
    with pytest.raises(ValueError, match="no question for a"):
        prompts.loaded(rows.where("id = 'b'"), graphs, evidence, known)
    got = prompts.loaded(rows, graphs, evidence, known, "scored_5_gt").collect()
    assert [(r.id, r.q_entity, [(x.h, x.score) for x in r.triples]) for r in got] == [("a", ["x"], [("3", None), ("1", None), ("h", 0.5)])]
    other = prompts.loaded(rows, graphs, evidence.withColumnRenamed("scored_triples", "triples"), known, "scored_5", limit=1).collect()
    assert [(r.id, r.q_entity, [x.h for x in r.triples]) for r in other] == [("b", ["e"], [""])]
