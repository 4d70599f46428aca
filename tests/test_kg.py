import random

import pytest

from lattica.operators import graph, metrics, retrieval
from lattica.plans import catalogue
from lattica.sources import records

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", catalogue.ORACLES)
def test_query_equals_sql(spark, same, name):
    same(catalogue.QUERIES[name](spark, SF), catalogue.ORACLES[name], SF)


def test_run_recall_ranks_every_triple(spark, same, tmp_path):
    """Customers with forty orders, all of which score more than the triple of their region."""
    for name in ("customer", "nation", "region", "orders", "lineitem", "part"):
        table = catalogue.table(spark, SF, name)
        if name == "customer":
            table = table.where("c_custkey <= (select min(c_custkey) + 11 from parquet.`%s/customer.parquet`)" % SF)
        if name == "orders":
            low = catalogue.table(spark, SF, "customer").selectExpr("min(c_custkey)").first()[0]
            table = table.orderBy("o_orderkey").limit(480).selectExpr("* except (o_custkey, o_totalprice)", f"o_orderkey % 12 + {low} o_custkey", "cast(2e5 as double) o_totalprice")
        table.toPandas().to_parquet(tmp_path / f"{name}.parquet", coerce_timestamps="us")
    got = catalogue.QUERIES["kg_run_recall"](spark, str(tmp_path))
    recall = {r.k: r.recall for r in got.collect()}
    assert recall[10] < 1 and recall[100] == 1
    same(got, catalogue.ORACLES["kg_run_recall"], tmp_path)


def labels(spark, edges, q, a):
    triples = spark.createDataFrame([(1, i, h, "r", t) for i, (h, t) in enumerate(edges)], "sample_id int, triple_id int, h string, r string, t string")
    found, length = graph.shortest_path_labels(triples, spark.createDataFrame([(1, q, a)], "sample_id int, q string, a string"))
    return sorted(r.triple_id for r in found.where("label > 0").collect()), [r.max_path_length for r in length.collect()]


@pytest.mark.parametrize(("edges", "q", "a", "want"), [
    ("AB BC", "A", "C", ([0, 1], [2])),
    ("AB BD AC CD", "A", "D", ([0, 1, 2, 3], [2])),
    ("AB BC CA", "A", "B", ([0], [1])),
    ("AB BA", "A", "B", ([0, 1], [1])),
    ("AB AB", "A", "B", ([1], [1])),
    ("AB", "A", "A", ([], [0])),
    ("AB CD", "A", "D", ([], [None])),
])
def test_shortest_path_labels(spark, edges, q, a, want):
    assert labels(spark, [tuple(x) for x in edges.split()], q, a) == want


def plain_labels(edges, pairs):
    """Brute force: distances from every node; an edge counts if it lies on a shortest way of the shorter direction."""
    out = {}
    for h, t in edges:
        out.setdefault(h, set()).add(t)

    def far(s):
        d, level = {s: 0}, [s]
        while level:
            level = [y for x in level for y in sorted(out.get(x, ())) if y not in d and not d.update({y: d[x] + 1})]
        return d

    on, lengths, last = set(), [], {e: i for i, e in enumerate(edges)}
    for q, a in pairs:
        found = [(far(s)[e], s, e) for s, e in ((q, a), (a, q)) if e in far(s)]
        for n, s, e in found:
            if n == min(found)[0]:
                lengths.append(n)
                on |= {i for (h, t), i in last.items() if h in far(s) and e in far(t) and far(s)[h] + 1 + far(t)[e] == n}
    return on, max(lengths, default=None)


def test_shortest_path_labels_equal_brute_force(spark):
    """Samples from sparse to dense, with ways of up to eight edges, loops, repeated edges, pairs that share ends, pairs
    without a path in one or both directions, ends that no edge has and null ends."""
    rng = random.Random(5)
    graphs, asked = {}, {}
    for i in range(24):
        n = rng.choice((6, 12, 20))
        graphs[i] = [(str(rng.randrange(n)), str(rng.randrange(n))) for _ in range(int(n * rng.choice((0.8, 1.2, 2.5))))]
        asked[i] = [(str(rng.randrange(n + 1)), str(rng.randrange(n + 1))) for _ in range(4)]
    graphs[24], asked[24] = [(str(i), str(i + 1)) for i in range(8)], [("0", "8"), ("7", "2"), ("8", "0")]
    triples = spark.createDataFrame([(i, k, h, "r", t) for i, g in graphs.items() for k, (h, t) in enumerate(g)], "sample_id int, triple_id int, h string, r string, t string")
    pairs = spark.createDataFrame([(i, *p) for i, x in asked.items() for p in x] + [(0, None, "1"), (25, "x", "y")], "sample_id int, q string, a string")
    labels, length = graph.shortest_path_labels(triples, pairs)
    assert labels.count() == triples.count()
    on = {(r.sample_id, r.triple_id) for r in labels.where("label > 0").collect()}
    want = {i: plain_labels(g, asked[i]) for i, g in graphs.items()}
    assert on == {(i, k) for i, w in want.items() for k in w[0]}
    assert {r.sample_id: r.max_path_length for r in length.collect()} == {i: w[1] for i, w in want.items()} | {25: None}
    assert max(w[1] or 0 for w in want.values()) == 8


def test_hops_both_ways(spark):
    rng = random.Random(6)
    edges = {(i, *map(str, sorted(rng.sample(range(30), 2)))) for i in range(6) for _ in range(30)}
    step = spark.createDataFrame([x for i, a, b in edges for x in ((i, a, b), (i, b, a))], "sample_id int, node string, to string")
    start = spark.createDataFrame([(i, str(k)) for i in range(6) for k in range(i % 3 + 1)], "sample_id int, node string")
    rows = lambda x: sorted(map(tuple, x.select("sample_id", "node", "d").collect()))
    assert rows(graph.hops(step, start, ["sample_id"], both_ways=True)) == rows(graph.hops(step, start, ["sample_id"]))


def test_corrupted_are_new_and_repeatable(spark):
    first = catalogue.QUERIES["kg_corrupted"](spark, SF)
    old = catalogue.scored(spark, SF)
    assert first.join(old, ["sample_id", "h", "r", "t"]).count() == 0
    assert sorted(first.collect()) == sorted(catalogue.QUERIES["kg_corrupted"](spark, SF).collect())


def test_short_samples_and_empty_predictions(spark):
    s = spark.createDataFrame([(1, 0, "a", "r", "b", 0.5)], "sample_id int, triple_id int, h string, r string, t string, score double")
    assert retrieval.top_k(s, 50).count() == 1
    rows = spark.createDataFrame([(1, [], ["x"]), (2, ["The x."], ["x"])], "id int, predictions array<string>, answers array<string>")
    assert [(r.hit, r.f1) for r in metrics.answer_scores(rows).orderBy("id").collect()] == [(0, 0.0), (1, 1.0)]


def test_records(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "a", "n": 1}\n\nbroken\n{"id": "a", "n": 2}\n')
    rows = records.read_jsonl(spark, str(tmp_path / "x.jsonl"), "id string, n int")
    assert [tuple(r) for r in records.last_by_id(rows, "id", "n").collect()] == [("a", 2)]
    assert records.not_done(rows, rows).count() == 0
