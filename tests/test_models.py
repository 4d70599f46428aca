import numpy as np
from pyspark.sql import functions as F

from lattica.operators import conversation, model


def test_gradient_equals_differences():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(7, 4)), rng.integers(0, 2, 7).astype(float)
    net = model.Network(4, 3)
    g = net.gradient(x, y)
    for i in range(len(net.weights)):
        step = np.zeros(len(net.weights))
        step[i] = 1e-6
        up, down = (model.Network(4, 3, net.weights + s).gradient(x, y)[-2] for s in (step, -step))
        assert abs((up - down) / 2e-6 - g[i]) < 1e-5


def test_gradient_of_the_learned_vector_equals_differences():
    rng = np.random.default_rng(0)
    x, y, free = rng.normal(size=(9, 14)), rng.integers(0, 2, 9).astype(float), rng.integers(0, 2, (9, 2))
    net = model.Network(14, 3, free=3)
    g = net.gradient(x, y, free)
    assert len(g) == len(net.weights) + 2 and np.abs(g[-5:-2]).max() > 0
    for i in range(len(net.weights)):
        step = np.zeros(len(net.weights))
        step[i] = 1e-6
        up, down = (model.Network(14, 3, net.weights + s, free=3).gradient(x, y, free)[-2] for s in (step, -step))
        assert abs((up - down) / 2e-6 - g[i]) < 1e-5
    assert np.array_equal(model.Network(14, 3, net.weights[:-3]).logits(x), net.logits(x, np.zeros((9, 2), int)))


def test_training_by_batches_with_a_learned_vector(spark):
    """The wanted triples are those whose tail has no text; only its learned vector tells them apart."""
    triples = spark.createDataFrame([(s, i, f"node {i}", "r", "m.1" if i == s % 4 else "end") for s in range(6) for i in range(4)], "sample_id int, triple_id int, h string, r string, t string")
    labels = triples.select("sample_id", "triple_id", F.col("t").startswith("m.").cast("double").alias("label"))
    nodes = triples.select("sample_id", F.explode(F.array("h", "t")).alias("node")).distinct().withColumn("x0", F.lit(1.0))
    questions = triples.select("sample_id", F.lit("which?").alias("question")).distinct()
    texts = triples.select(F.explode(F.array("h", "r", "t")).alias("text")).where("not text like 'm.%'")
    rows = model.features(triples, questions, nodes, model.embedded(texts, lambda x: np.zeros((len(x), 4), np.float32)))
    assert {tuple(r.free) for r in rows.collect()} == {(0, 0), (0, 1)}
    net, history = model.train(rows, labels, triples, hidden=8, rate=0.05, epochs=6, patience=6, k=1, batches=3, free=4)
    one, slow = model.train(rows, labels, triples, hidden=8, rate=0.05, epochs=6, patience=6, k=1, batches=1, free=4)
    assert max(h[0] for h in history) == 1.0 and history[-1][1] < history[0][1] and history[-1][1] < slow[-1][1]
    x, y, free = (np.stack(v) if v[0].__class__ is list else np.array(v) for v in zip(*((r.x, r.label, r.free) for r in rows.join(labels, ["sample_id", "triple_id"]).collect())))
    whole = model.gradient(rows.join(labels, ["sample_id", "triple_id"]), net)
    assert np.allclose(whole, net.gradient(x, y, free))


def test_training_finds_the_labelled_triples(spark):
    triples = spark.createDataFrame([(s, i, f"node {i}", "good" if i == s % 4 else "bad", "end") for s in range(6) for i in range(4)], "sample_id int, triple_id int, h string, r string, t string")
    labels = triples.select("sample_id", "triple_id", (F.col("r") == "good").cast("double").alias("label"))
    nodes = triples.select("sample_id", F.explode(F.array("h", "t")).alias("node")).distinct().withColumn("x0", F.lit(1.0))
    questions = triples.select("sample_id", F.lit("which?").alias("question")).distinct()
    e = model.embedded(triples.select(F.explode(F.array("h", "r")).alias("text")), lambda x: model.hashed(x, 8))
    rows = model.features(triples, questions, nodes, e)
    assert {len(r.x) for r in rows.collect()} == {34}
    net, history = model.train(rows, labels, triples, hidden=8, rate=0.05, epochs=12, patience=8, k=1)
    assert max(h[0] for h in history) == 1.0 and history[-1][1] < history[0][1]
    assert model.scored(rows, net).where("score between 0 and 1").count() == 24


def rows(spark, steps=None, n=12):
    lines = [(f"(e{i},r,Oslo)" if i < 7 else f"(e{i},r,x)", n - i, "filler") for i in range(n)]
    query = "Triplets:\n" + "\n".join(x for x, _, _ in lines) + "\n\nQuestion:\nwhere?"
    df = spark.createDataFrame([(1, "where?", query, lines, steps)], "id int, question string, user_query string, lines array<struct<text:string,priority:bigint,bucket:string>>, steps array<struct<sub_id:int,question:string,needs_prev_answer:boolean>>")
    return df.withColumn("messages", conversation.conversation("Answer.", F.col("user_query")))


def test_truncation_drops_the_least_important(spark):
    r = conversation.truncated(rows(spark), 10, 2).first()
    assert r.removed == 8 and [m.content for m in r.messages][1] == "Triplets:\n" + "\n".join(f"(e{i},r,Oslo)" for i in range(4)) + "\n\nQuestion:\nwhere?"
    got = rows(spark).select(conversation.evidence_turn(F.col("messages")).alias("at"), conversation.without_evidence(F.col("messages"))[1].content.alias("q")).first()
    assert tuple(got) == (1, "Question:\nwhere?")
    assert conversation.truncated(rows(spark), 500).first().removed == 0


def test_chain_hands_answers_on(spark):
    def make():
        return lambda messages: "ans: Oslo" if "Subquestion Step 1" in messages[-1]["content"] else f"ans: {messages[-1]['content'].count('(e')} {'Step 1: Oslo' in messages[-1]['content']}"

    r = conversation.answered(rows(spark, [(1, "b of [B]?", True), (0, "a?", False)]), make, "Answer.").first()
    assert [c.answers for c in r.chain] == [["Oslo"], ["11 True"]]
    assert r.prediction == "ans: 12 True"


def test_second_turn_only_if_unsure_and_retries(spark):
    def make():
        seen = []

        def client(messages):
            seen.append(1)
            if len(seen) == 1:
                raise ConnectionError
            return f"ans: {len(messages)}" if len(messages) > 2 else "I don't know"

        return client

    conversation.ask(make(), [{"role": "user", "content": "x"}], {}, 10, wait=0)
    calm = lambda: lambda messages: f"ans: {len(messages)}" if len(messages) > 2 else "I don't know"
    assert conversation.answered(rows(spark), calm, "Answer.", "Please.", "if_unsure").first().prediction == "ans: 4"
    assert conversation.answered(rows(spark), calm, "Answer.").first().prediction == "I don't know"
