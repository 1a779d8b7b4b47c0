import hashlib
import re

import pytest
from pyspark.sql import functions as F

from brindle.functions import belief
from brindle.operators import graph, linkpred, pattern, predict, recall, terms
from brindle.plans import lineage

EDGE = "seq int, src string, dst string, type string, directed boolean, weight double, confidence double, modality string, ambiguity string, props string"


def edges(spark, *rows):
    full = [(i, s, d, t, True, *(more[:2] or [1.0, None]), None, None, *(more[2:] or ["{}"])) for i, (s, d, t, *more) in enumerate(rows)]
    return graph.upsert_edges(spark.createDataFrame(full, EDGE))


def nodes(spark, e):
    return graph.endpoints(e).select("id", F.array().cast("array<string>").alias("labels"))


@pytest.fixture(scope="module")
def known(spark):
    return edges(
        spark, ("cat:luna", "breed:siamese", "has_breed"), ("breed:siamese", "trait:vocal", "has_trait"), ("cat:luna", "city:berlin", "lives_in"), ("person:marco", "city:berlin", "lives_in"),
        ("person:marco", "hobby:sailing", "likes"), ("city:berlin", "country:germany", "located_in"),
    ).cache()


def test_recall_reproduces_the_published_scores(spark, known):
    aliased = known.unionByName(edges(spark, ("city:berlin", "city:berlino", "alias")))
    asked = spark.createDataFrame([("q", "cat:luna"), ("q", "person:marco")], "query string, seed string")
    found = recall.recall(asked, nodes(spark, aliased), aliased, recall.Options(hops=2, precision=0.1)).orderBy("rank").collect()
    got = {r.node: (r.score, r.novelty, r.distance, r.source_count) for r in found}
    assert got["city:berlin"] == (0.7975, 0.39875, 1, 2)
    assert got["breed:siamese"] == got["hobby:sailing"] == (0.55, 0.1375, 1, 1)
    assert got["country:germany"] == (0.513494, 0.342329, 2, 2)
    assert got["trait:vocal"] == (0.3025, 0.100833, 2, 1)
    assert found[0].node == "city:berlin" and [e.dst for e in next(r for r in found if r.node == "country:germany").via] == ["city:berlin", "country:germany"]
    bridges = recall.recall(asked, nodes(spark, aliased), aliased, recall.Options(hops=2, precision=0.1, min_sources=2)).collect()
    assert all(r.source_count == 2 for r in bridges)


def test_seeds_by_name_typo_and_synonym(spark, known):
    e = known.unionByName(edges(spark, ("city:berlin", "city:berlino", "alias")))
    asked = spark.createDataFrame([("a", "berlin"), ("b", "berln")], "query string, seed string")
    found = {(r.seed, r.node): r.match for r in recall.resolve(asked, nodes(spark, e), e).collect()}
    assert found[("berlin", "city:berlin")] == "lexical" and found[("berlin", "city:berlino")] == "synonym" and found[("berln", "city:berlin")] == "fuzzy"


def test_a_budget_cuts_the_spread_short(spark, known):
    asked = spark.createDataFrame([("q", "cat:luna", "cat:luna", 1.0)], "query string, seed string, node string, score double")
    full = recall.spread(asked, known, recall.Options(hops=3, precision=0.01))
    cut = recall.spread(asked, known, recall.Options(hops=3, precision=0.01, budget=3))
    assert cut.count() < full.count() and all(r.truncated for r in cut.collect()) and not any(r.truncated for r in full.collect())


def test_similar(spark):
    e = edges(spark, ("cat:luna", "breed:siamese", "has_breed"), ("cat:luna", "city:berlin", "lives_in"), ("cat:mia", "breed:siamese", "has_breed"), ("cat:mia", "city:berlin", "lives_in"), ("person:marco", "hobby:sailing", "likes"))
    asked = spark.createDataFrame([("cat:luna",)], "id string")
    first = recall.similar(asked, nodes(spark, e), e).orderBy(F.desc("score")).collect()
    assert (first[0].candidate, first[0].shared_count, first[0].context) == ("cat:mia", 2, 1.0) and first[0].lexical > 0
    assert all(r.candidate != "person:marco" for r in first)
    assert all(r.lexical == 0 for r in recall.similar(asked, nodes(spark, e), e, by="context").collect())


def test_multi_hop_cost(spark):
    e = edges(spark, ("a", "b", "link", 1.0, None, "{}"), ("b", "c", "link", 1.0, None, "{}"), ("a", "d", "link", 0.2, None, "{}"), ("d", "c", "link", 0.2, None, "{}"))
    got = pattern.query(e, nodes(spark, e), "MATCH (id='a')-[:link]->(id='c') HOPS 2 BRANCH_LIMIT 8 COST_LIMIT 3 RETURN edges").collect()
    assert [(r.src, r.dst) for r in got] == [("b", "c")]


def test_reducers(spark):
    e = edges(spark, ("a", "b", "r"), ("a", "c", "r"), ("b", "c", "r"), ("c", "b", "r"))
    page = graph.adjacency(e, "out").where("node = 'a'")
    assert [(r.dir, r.node, r.degree) for r in graph.reduce_degree(page).collect()] == [("out", "a", 2)]
    t = graph.reduce_triangles(page, e).first()
    assert (t.closed, t.neighbors, t.coefficient) == (1, 2, 1.0)
    assert [r.node for r in graph.reduce_pagerank_seed(page, e, limit=10).collect()] == ["b", "c", "a"]


def test_property_predicates_are_typed(spark):
    e = edges(spark, ("x", "1", "t", 1.0, None, '{"k":5}'), ("x", "2", "t", 1.0, None, '{"k":"5"}'), ("x", "3", "t", 1.0, None, "{}"), ("x", "4", "t", 1.0, None, '{"k":true,"n":{"m":"7"}}'))
    ask = lambda w: sorted(r.dst for r in pattern.query(e, nodes(spark, e), f"MATCH (id='x')-[]->(*) WHERE edge.props.{w}").collect())
    assert ask("k = 5") == ["1"] and ask("k = '5'") == ["2"] and ask("k = true") == ["4"]
    assert "3" in ask("k != 5") and ask("n.m = 7") == ["4"] and ask("k > 4") == ["1", "2"]


def test_belief(spark):
    e = spark.createDataFrame([(i, "marco", d, "likes", True, 1.0, None, m, None, None) for i, (d, m) in enumerate([("blue", "possible"), ("green", "probable"), ("red", "ruled_out")])], EDGE)
    e = graph.upsert_edges(e)
    ask = lambda w: pattern.query(e, nodes(spark, e), f"MATCH (id='marco')-[]->(*) WHERE {w}").count()
    assert [ask(w) for w in ("edge.modality = 'possible'", "edge.modality >= 'possible'", "edge.modality != 'ruled_out'", "edge.confidence >= 0.5", "edge.confidence >= possible", "edge.confidence > 0")] == [1, 2, 2, 2, 2, 2]
    words = spark.createDataFrame([(0.125,), (0.126,), (0.875,), (0.876,), (None,)], "c double").select(belief.modality_of(F.col("c")).alias("m"))
    assert [r.m for r in words.collect()] == ["ruled_out", "unlikely", "probable", "certain", None]


@pytest.mark.parametrize(("options", "shares"), [([("a", 0.7), ("b", None)], {"a": 0.7, "b": 0.3}), ([("a", 4.0), ("b", 0.0), ("c", None)], {"a": 0.666667, "b": 0.0, "c": 0.333333})])
def test_shares(spark, options, shares):
    got = graph.distribute(spark.createDataFrame([(1, *o) for o in options], "g int, dst string, share double"), group=["g"])
    assert {r.dst: r.confidence for r in got.collect()} == shares


@pytest.mark.parametrize("text", ["MATCH (label='x')-[]->(*)", "MATCH (*)-[]->(*)", "MATCH (id='a')-[]->(*) LIMIT 3 WHERE edge.weight > 1", "MATCH (id='a')-[]->(*) HOPS 3..2", "MATCH (id='a')-[]->(*) RETURN rows", "MATCH (id='a')<-[]->(*)"])
def test_queries_that_are_refused(text):
    with pytest.raises(ValueError):
        pattern.parse(text)


def test_tokens(spark):
    row = spark.createDataFrame([("Ärger, über-all 2x 2X",)], "t string").select(terms.tokens(F.col("t")).alias("w")).first()
    assert row.w == ["ärger", "über", "all", "2x"]


def test_common_neighbours_travel_as_lists_of_numbers(spark):
    """Pairs of asked nodes and their like never meet as rows of their own in a shuffle, whichever few are asked."""
    e = edges(spark, *[(f"s:{i}", f"p:{j}", "supplies") for i in range(12) for j in range(30) if (i * j) % 5 < 2])
    near = {i: {j for j in range(30) if (i * j) % 5 < 2} for i in range(12)}
    n = nodes(spark, e)
    for few in (range(12), (3,)):
        asked = spark.createDataFrame([(f"s:{i}",) for i in few], "id string")
        got = {(r.id, r.candidate): (r.context, r.shared_count, list(r.shared)) for r in recall.similar(asked, n, e, by="context", precision=0.4, limit=None).collect()}
        want = {(f"s:{i}", f"s:{k}"): (near[i] & near[k], near[i] | near[k]) for i in few for k in range(12) if i != k}
        assert got == {k: (int(len(a) / len(b) * 1e6 + 0.5) / 1e6, len(a), sorted(f"p:{j}" for j in a)[:8]) for k, (a, b) in want.items() if len(a) / len(b) >= 0.4}
    plan = recall.common(spark.createDataFrame([("s:3",)], "id string"), e, direction="both", precision=0.4, listed=False)
    assert {f.name for f in plan.schema} == {"id", "candidate", "context", "shared_count", "shared"}


def test_equal_starts_spread_once_and_only_over_links_of_what_is_reached(spark, known):
    rows = [(f"q{i}", s) for i in range(20) for s in ("city:berlin", "cat:luna" if i % 2 else f"none:{i}")]
    asked = spark.createDataFrame(rows, "query string, seed string")
    seeds = asked.select("query", "seed", F.col("seed").alias("node"), F.lit(1.0).alias("score"))
    o = {"hops": 3, "precision": 0.01}
    columns = ["query", "seed", "node", "activation", "depth", "hops", "path"]
    alone = recall.spread(seeds, known, recall.Options(**o, budget=262_144)).select(*columns)
    assert sorted(map(repr, recall.spread(seeds, known, recall.Options(**o)).select(*columns).collect())) == sorted(map(repr, alone.collect()))
    bare = recall.recall_exact(asked, known, recall.Options(**o, limit=None), paths=False)
    full = recall.recall_exact(asked, known, recall.Options(**o, limit=None))
    assert sorted(map(repr, bare.drop("via").collect())) == sorted(map(repr, full.drop("via").collect())) and bare.where("via is not null").isEmpty()
    near = recall.links(known, recall.Options(), spark.createDataFrame([("city:berlin",)], "node string"))
    assert {r.node for r in near.collect()} == {"city:berlin"}


def test_a_sieve_lets_through_all_that_are_in_it_and_few_others(spark):
    ids = spark.range(2000).select(F.concat(F.lit("n:"), "id").alias("id"))
    bits = lineage.sieve(ids.where("id like 'n:1%'"), "id")
    told = {r.id: r.m for r in lineage.flagged(ids, "id", bits, "m").collect()}
    assert all(m for i, m in told.items() if i.startswith("n:1")) and sum(told.values()) < 1200
    assert lineage.passing(ids, "id", bits).columns == ["id"]


def test_ends_that_are_not_deleted_are_not_shuffled(spark, known):
    gone = spark.createDataFrame([("city:berlin",), ("nobody",)], "id string")
    left = graph.delete_nodes(nodes(spark, known), known, gone, cascade=True)[1]
    assert {(r.src, r.dst) for r in left.collect()} == {(r.src, r.dst) for r in known.collect() if "city:berlin" not in (r.src, r.dst)}
    assert "Union" in left._jdf.queryExecution().optimizedPlan().toString()  # most go past the joins


def test_page_of_types_is_ranked_in_parts_of_bounded_size(spark, known, monkeypatch):
    monkeypatch.setattr(graph, "SORTED", 1)
    rows = graph.neighbor_types(known, direction="both", limit=1)
    assert re.search(rf"RepartitionByExpression \[node#\d+\], {2 * known.count()}\b", rows._jdf.queryExecution().optimizedPlan().toString())
    assert {r.node: r.n for r in rows.groupBy("node").agg(F.sum("n").alias("n")).collect()}["city:berlin"] == 2


def test_split_holds_out_the_share_without_ordering_all(spark):
    df = spark.createDataFrame([("r", f"s:{i}", "d", 0.5) for i in range(50)], "relation string, src string, dst string, p double")
    train, held = linkpred.split(df, 0.3)
    order = sorted(range(50), key=lambda i: hashlib.md5(f"42\x1fr\x1fs:{i}\x1fd".encode()).hexdigest())
    assert {r.src for r in held.collect()} == {f"s:{i}" for i in order[:15]} and train.count() == 35
    assert "Window" not in held._jdf.queryExecution().optimizedPlan().toString()
    copies = df.where("src = 's:1'").unionByName(df.where("src = 's:1'")).unionByName(df.where("src = 's:1'"))
    assert [x.count() for x in linkpred.split(copies, 0.3)] == [2, 1]


def test_training_steps_stream_through_python(spark):
    none = "array<struct<depth:int,vector:array<double>,bias:double>>"
    pred = spark.createDataFrame([(k, v, 0.1 * i, []) for k in "abc" for i, v in enumerate("xyz")], f"key string, value string, score double, weights {none}")
    steps = spark.range(60).selectExpr("substr('abcd', cast(id % 4 as int) + 1, 1) as key", "id as seq", "substr('xyzw', cast(id % 3 as int) + 1, 1) as target", "array('y') as negatives", "0.1D as rate", "array(array(id / 60)) as context")
    whole = predict.train(pred, steps)
    assert "MapInPandas" in whole._jdf.queryExecution().toString()  # a key's steps are never one table in Python
    expected = sorted(map(repr, whole.collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        assert sorted(map(repr, predict.train(pred, steps).collect())) == expected and len(expected) == 9
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
