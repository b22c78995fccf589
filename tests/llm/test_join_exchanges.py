"""The n-gram join and its components: few exchanges, each of which costs files in every task, and unchanged results."""

import random

import pytest
from pyspark.sql import functions as F

from caisse.llm import common, components, jaccard


@pytest.fixture(scope="module", autouse=True)
def prepared(spark):
    common.prepare(spark)


def exchanges(spark, df):
    """Exchanges of the plan when no side is broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return plan.count("Exchange hashpartitioning")


def brute(nodes, edges):
    of = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            if a is not None and b is not None:
                of[a] = of[b] = min(of[a], of[b])
    return of


def test_overlaps_bring_the_sizes_without_a_join(spark):
    rows = [(1, 5, [[1, 2], [7, 8, 9]]), (2, 4, [[2], [7, 8, 10]]), (3, 3, [[3], [7, 9]])]
    sets = spark.createDataFrame(rows, "cid long, n long, frags array<array<long>>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "a long, b long")
    found = jaccard._overlaps(pairs, sets)
    assert sorted(tuple(r) for r in found.select("a", "b", "na", "nb", "i").collect()) == [(1, 2, 5, 4, 3), (1, 3, 5, 3, 2), (2, 3, 4, 3, 1)]
    assert exchanges(spark, found) <= 5


def test_repeated_rows_meet_where_the_join_put_them(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (1, text), (1, "an other text of the same id"), (2, text + " end")], "doc_id long, text string")
    classes = jaccard.shingle_rows(docs, "doc_id", "text", 5).groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))
    classes = common.cut(classes.select(F.monotonically_increasing_id().alias("cid"), "sig", "rep", "n"))
    seen = []
    monkeypatch.setattr(jaccard, "cut", lambda df: seen.append(df) or common.cut(df))
    sets = jaccard._candidates(docs, "doc_id", "text", classes, 5, 80)
    assert sorted((r.n, sum(map(len, r.frags))) for r in sets.collect()) == [(56, 56), (57, 56)]
    # Nothing deals the texts' n-grams out by id and class once more.
    assert exchanges(spark, seen[-1]) <= 8


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_components_of_odd_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(200, 200 + i) for i in range(1, 30)]
    edges += [(None, 3), (5, None), (7, 7)] + [(b, a) for a, b in edges[:10]]
    nodes = list(range(240))
    want = brute(nodes, edges)
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components.connected_components(df).collect()}
    assert got == {n: want[n] for n in {x for a, b in edges if None not in (a, b) and a != b for x in (a, b)}}
    rows = spark.createDataFrame([(n, "x") for n in [*nodes, None, 4]], "cid long, v string")
    found = components.with_component(rows, "cid", df)
    assert found.columns == ["cid", "v", "component"]
    assert sorted((r.cid, r.component) for r in found.collect() if r.cid is not None) == sorted((n, want[n]) for n in [*nodes, 4])
    assert [r.component for r in found.filter("cid is null").collect()] == [None]


def test_a_round_of_components_has_seven_exchanges(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(components, "cut", lambda df: seen.append(exchanges(spark, df)) or common.cut(df))
    components.connected_components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")).count()
    assert len(seen) > 1 and max(seen[1:]) <= 7


def test_first_of_each_group_stays(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(500)}" for _ in range(80)] for _ in range(12)]
    rows = []
    for i, words in enumerate(base):
        rows += [(10 * i + j, " ".join(words[: 80 - j])) for j in range(3 + i % 4)]
    rows += [(500, None), (500, None), (501, ""), (None, "a b c"), (0, "another text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in jaccard.keep_first(docs).collect())
    want = [(10 * i, " ".join(w)) for i, w in enumerate(base)] + [(500, ""), (501, ""), (-1, "a b c"), (0, "another text")]
    assert got == sorted(want)
