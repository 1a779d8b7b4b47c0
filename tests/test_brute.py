"""Registered queries that have no SQL, against plain Python over the same tables."""

import math
from collections import defaultdict

import pytest

from brindle.operators import placement, predict, recall, terms
from brindle.plans import inputs, registry


def test_every_prefix_is_where_the_ring_has_it(spark, small):
    ring = placement.Topology([placement.Member("a", capacity=4), placement.Member("b", capacity=2), placement.Member("c")], replication=2)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("lang", "source").distinct().collect()
    got = {r.prefix: (r.fork, list(r.nodes)) for r in registry.QUERIES["fork_assign"](spark, small).collect()}
    assert got == {p: (f, list(n)) for r in docs for p in [f"ctx:{r.lang}:{r.source}"] for f, n in [ring.assign(p)]}


def test_training_steps_one_by_one(spark, small):
    state = defaultdict(dict)
    for r in inputs.pred(spark, small).collect():
        state[r.key][r.value] = [r.score, {w["depth"]: [list(w["vector"]), w["bias"]] for w in r.weights}]
    users = defaultdict(list)
    for r in spark.read.parquet(f"{small}/events.parquet").orderBy("event_id").collect():
        users[r.user_id].append(r)
    steps = sorted(((a.event_id, a.event_type, b.event_type, a.value) for own in users.values() for a, b in zip(own, own[1:])))
    for _, key, target, value in steps:
        if key not in state:
            continue
        context = predict.deepen([[value / 500]])
        for what in [target] + (["error"] if target != "error" else []):
            score, weights = state[key].get(what, [0.05, {}])
            term = sum(sum(x * y for x, y in zip(row, weights[d][0])) + weights[d][1] for d, row in enumerate(context) if d in weights)
            share = 1 / (1 + math.exp(-(score + term)))
            by = 0.01 * ((1 - share) if what == target else -share)
            for d, row in enumerate(context):
                vector, bias = weights.get(d, [[], 0.0])
                vector = vector + [0.0] * (len(row) - len(vector))
                weights[d] = [[v + by * (row[i] if i < len(row) else 0.0) for i, v in enumerate(vector)], bias + by]
            state[key][what] = [min(max(score + by, -24), 24), weights]
    got = {(r.key, r.value): (r.score, r.depths) for r in registry.QUERIES["pred_train_sequence"](spark, small).collect()}
    want = {(k, v): (s, len(w)) for k, own in state.items() for v, (s, w) in own.items()}
    assert len(steps) > 100 and got.keys() == want.keys()
    for k, (score, depths) in want.items():
        assert got[k][0] == pytest.approx(score, abs=2e-6) and got[k][1] == depths


def test_similar_by_neighbours_and_name(spark, small):
    edges = inputs.edges(spark, small).select("src", "dst").collect()
    nodes = inputs.nodes(spark, small)
    near = defaultdict(set)
    for e in edges:
        if e.src != e.dst:
            near[e.src].add(e.dst)
            near[e.dst].add(e.src)
    bare = {r.id: list(r.t) for r in nodes.select("id", terms.tokens(nodes["id"]).alias("t")).collect()}
    df = defaultdict(int)
    for r in terms.node_tokens(nodes).collect():
        for t in set(r.tokens):
            df[t] += 1
    n = len(bare)
    weight = {t: math.log((n + 1) / (min(df[t], n) + 1)) + 1 for own in bare.values() for t in own}
    round6 = lambda x: math.floor(x * 1e6 + 0.5) / 1e6
    want = defaultdict(list)
    for asked in (i for i in bare if i.startswith("nation:")):
        words = set(bare[asked])
        total, mean = sum(weight[t] for t in words), sum(weight[t] for t in words) / len(words)
        for other in bare.keys() - {asked}:
            both = near[asked] & near[other]
            context = len(both) / len(near[asked] | near[other]) if both else 0.0
            same = words & set(bare[other])
            lexical = min(1.0, sum(weight[t] for t in same) / (total + mean * max(len(bare[other]) - len(same), 0))) if same else 0.0
            score = 1 - (1 - context) * (1 - lexical)
            if score >= 0.05:
                want[asked].append((-round6(score), other, round6(context), round6(lexical), len(both), sorted(both)[:8]))
    got = defaultdict(list)
    for r in registry.QUERIES["similar_all"](spark, small).collect():
        got[r.id].append((-r.score, r.candidate, r.context, r.lexical, r.shared_count, list(r.shared)))
    assert got.keys() == want.keys()
    for k, rows in want.items():
        best = sorted(rows)[:32]
        mine = sorted(got[k])
        assert len(mine) == len(best)
        for a, b in zip(mine, best):
            assert a[1] == b[1] and a[4:] == b[4:] and a[0] == pytest.approx(b[0], abs=2e-6) and a[2:4] == pytest.approx(b[2:4], abs=2e-6)


def test_evidence_is_of_the_graph(spark, small):
    nodes = inputs.nodes(spark, small)
    labels = {r.id: list(r.labels) for r in nodes.collect()}
    edges = inputs.edges(spark, small)
    linked = {x for e in edges.select("src", "dst").collect() for x in ((e.src, e.dst), (e.dst, e.src))}
    names = spark.read.parquet(f"{small}/nation.parquet")
    asked = names.selectExpr("n_name as query", "n_name as seed")
    found = recall.recall(asked, nodes, edges, recall.Options(hops=2, precision=0.1)).collect()
    got = {(r.query, r.node): r for r in registry.QUERIES["recall_evidence"](spark, small).collect()}
    assert len(got) == len(found) > 0
    held = defaultdict(int)
    for r in sorted(found, key=lambda r: (r.query, r.rank)):
        mine = got[(r.query, r.node)]
        assert (mine["rank"], mine.score, mine.labels, mine.steps) == (r["rank"], r.score, labels[r.node], len(r.via))
        said = 1 if r.node.startswith("customer:") and held[r.query] < 256 else 0  # a sentence each, 256 a query at most
        held[r.query] += said
        assert max(mine.n_references or 0, 0) == said
        path = [(s.src, s.dst) for s in r.via]
        assert all(p in linked for p in path) and all(set(a) & set(b) for a, b in zip(path, path[1:])) and (not path or r.node in path[-1])
