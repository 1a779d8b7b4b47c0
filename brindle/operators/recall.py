"""Associative recall: activation spreads from seeds over weighted, believed edges; where several seeds meet, a noisy-or adds up.

Everything works on many queries at once: seeds carry the ``query`` they belong to, so one run answers a single question or a
whole table of them with the same joins.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import belief
from ..functions.literals import clamp01, round6
from ..plans.lineage import cut, numbered, passing, sieve, small
from . import terms
from .graph import adjacency, adjacency_order

SYNONYMS = ("synonym", "alias", "same_as", "aka", "abbreviation", "acronym")
SYNONYM_DECAY = 0.95
LEAST_ACTIVATION, EPSILON = 0.01, 1e-9
LEXICAL_CANDIDATES = 512


@dataclass(frozen=True)
class Options:
    precision: float = 0.25
    hops: int = 3
    direction: str = "both"
    decay: float = 0.55
    min_sources: int = 1
    branch: int = 64
    budget: int | None = None  # None: all is expanded; the reference's default is 4096
    seed_limit: int = 8
    limit: int | None = 128  # associations of a query
    include_seeds: bool = False
    types: tuple[str, ...] = ()
    lexical: bool = True
    synonyms: bool = True
    synonym_types: tuple[str, ...] = SYNONYMS
    cache_factor: float = 1.0
    relation_factors: Mapping[str, float] | None = None

    def __post_init__(self) -> None:
        if not 0 < self.decay <= 1:
            raise ValueError("invalid_decay")
        if self.direction not in ("out", "in", "both"):
            raise ValueError("invalid_direction")

    def clamped(self) -> Options:
        return replace(
            self, precision=min(max(self.precision, 0.0), 1.0), hops=min(max(self.hops, 1), 6), branch=min(max(self.branch, 1), 1024), min_sources=max(self.min_sources, 1),
            budget=None if self.budget is None else min(max(self.budget, 1), 262_144), seed_limit=max(self.seed_limit, 1),
        )


def noisy_or(activation: Column) -> Column:
    """Aggregate 1 - product of (1 - activation)."""
    return 1 - F.product(1 - activation)


# Seeds.


def resolve(asked: DataFrame, nodes: DataFrame, edges: DataFrame, options: Options | None = None, *, tokened: DataFrame | None = None) -> DataFrame:
    """Nodes that terms mean: (query, seed, node, score, match) for rows (query, seed).

    Exact ids score 1; nodes that share tokens .99 times the share of the evidence's weight; tokens that no node has match their nearest
    in the vocabulary; a synonym scores .95 of what it stands for.  Of several ways to a node the best counts, the first named of equals; the
    ``seed_limit`` best of each seed stay, ties by node.
    """
    o = (options or Options()).clamped()
    asked = small(asked.select("query", "seed").distinct())
    exact = asked.join(nodes.select(F.col("id").alias("node")), F.col("seed") == F.col("node")).select("query", "seed", "node", F.lit(1.0).alias("score"), F.lit("exact").alias("match"))
    found = exact
    if o.lexical:
        tokened = terms.node_tokens(nodes) if tokened is None else tokened
        posted = terms.postings(tokened)
        documents = tokened.agg(F.count("*").alias("documents"))
        words = small(asked.select("seed").distinct().select("seed", F.explode(terms.tokens(F.col("seed"))).alias("word")))
        meant = terms.postings_of(tokened, small(words.select(F.col("word").alias("token")).distinct()))
        weighed = words.join(terms.frequencies(meant).withColumnRenamed("token", "word"), "word", "left").crossJoin(F.broadcast(documents))  # one row
        weighed = cut(weighed.select("seed", "word", F.col("df").isNotNull().alias("known"), terms.idf(F.col("documents"), F.coalesce("df", F.lit(0))).alias("weight"), "documents"))
        same = weighed.where("known").select("seed", "word", "weight", F.col("word").alias("token"), F.col("weight").alias("evidence"), F.lit(False).alias("fuzzy"))
        if not weighed.where("not known").isEmpty():  # the whole vocabulary is for these only
            near = terms.fuzzy(weighed.where("not known").select(F.col("word").alias("token")), cut(terms.frequencies(posted))).withColumnRenamed("token", "word")
            other = weighed.where("not known").join(near, "word").select(
                "seed", "word", "weight", F.col("match").alias("token"), (F.least(terms.idf(F.col("documents"), F.col("df")), F.col("weight")) * F.col("similarity")).alias("evidence"), F.lit(True).alias("fuzzy")
            )
            same = small(same.unionByName(other))
            meant = terms.postings_of(tokened, small(same.select("token").distinct()))
        first = F.row_number().over(Window.partitionBy("token").orderBy("node"))
        listed = meant.withColumn("__r", first).where(F.col("__r") <= LEXICAL_CANDIDATES).drop("__r")
        hits = same.join(listed, "token")
        hits = hits.groupBy("seed", "node", "word").agg(F.max_by(F.struct("token", "evidence", "fuzzy"), F.struct("evidence", "token")).alias("e"))
        hits = hits.groupBy("seed", "node").agg(F.sum("e.evidence").alias("evidence"), F.collect_set("e.token").alias("matched"), F.bool_and("e.fuzzy").alias("fuzzy"))
        total = weighed.groupBy("seed").agg(F.sum("weight").alias("total"), F.avg("weight").alias("mean"))
        extra = F.size(F.array_except(terms.tokens(F.col("node")), F.col("matched")))
        share = clamp01(F.col("evidence") / (F.col("total") + F.col("mean") * extra))
        lexical = hits.join(total, "seed").withColumn("share", share).where((F.col("share") >= o.precision) & (F.col("share") > 0))
        lexical = lexical.select("seed", "node", round6(F.col("share") * 0.99).alias("score"), F.when(F.col("fuzzy"), "fuzzy").otherwise("lexical").alias("match"))
        found = found.unionByName(asked.join(lexical, "seed").select("query", "seed", "node", "score", "match"))
    order = F.struct("score", -F.array_position(F.array(*map(F.lit, ("exact", "lexical", "fuzzy", "synonym"))), F.col("match")))
    best = lambda df: df.groupBy("query", "seed", "node").agg(F.max_by(F.struct("score", "match"), order).alias("b")).select("query", "seed", "node", "b.*")
    found = best(found)
    if o.synonyms and o.synonym_types:
        same = adjacency(edges.where(F.lower("type").isin(*o.synonym_types)), "both").where("node <> peer").select("node", "peer").distinct()
        also = found.join(same, "node").select("query", "seed", F.col("peer").alias("node"), round6(F.col("score") * SYNONYM_DECAY).alias("score"), F.lit("synonym").alias("match"))
        found = best(found.unionByName(also))
    rank = F.row_number().over(Window.partitionBy("query", "seed").orderBy(F.desc("score"), "node"))
    return found.withColumn("__r", rank).where(F.col("__r") <= o.seed_limit).drop("__r")


# Spreading.


def affinity(weight: Column, confidence: Column) -> Column:
    return clamp01(weight) * clamp01(belief.effective_confidence(confidence))


def is_synonym(kind: Column, o: Options) -> Column:
    return F.lower(kind).isin(*o.synonym_types) if o.synonym_types else F.lit(False)


def effective_decay(kind: Column, o: Options) -> Column:
    """.95 over synonyms; else the decay times the cache's and the relation's factor, from 0 to 1."""
    factor = F.lit(1.0)
    if o.relation_factors:
        table = F.create_map(*[F.lit(x) for kv in o.relation_factors.items() for x in kv])
        factor = F.coalesce(table[kind], F.lit(1.0))
    return F.when(is_synonym(kind, o), F.lit(SYNONYM_DECAY)).otherwise(clamp01(F.lit(o.decay * o.cache_factor) * factor))


def links(edges: DataFrame, o: Options, nodes: DataFrame | None = None, *, named: bool = True) -> DataFrame:
    """(node, peer, gain, step, edge, type, src, dst): of each node and direction, and type if few are asked for, the first ``branch`` edges in adjacency order.

    With ``nodes`` (node) of those at least, whatever else the sieve lets through; the last four columns only if ``named``.
    """
    wanted = {*o.types, *(o.synonym_types if o.synonyms and o.types else ())}
    rows = edges.where(F.lower("type").isin(*wanted)) if wanted else edges
    scope = ["node", "dir"] + (["type"] if 0 < len(wanted) <= 8 else [])
    rows = adjacency(rows, o.direction).select(
        "node", "peer", "dir", "type", "directed", (affinity(F.col("weight"), F.col("confidence")) * effective_decay(F.col("type"), o)).alias("gain"),
        F.when(is_synonym(F.col("type"), o), 0).otherwise(1).alias("step"), *(["id"] if named else []),
    )
    if nodes is not None:
        rows = passing(rows, "node", sieve(nodes, "node"))
    rows = rows.repartition("node").withColumn("__r", F.row_number().over(Window.partitionBy(*scope).orderBy(*adjacency_order()))).where(F.col("__r") <= o.branch)
    rows = rows.where("node <> peer")
    if not named:
        return rows.select("node", "peer", "gain", "step")
    out = F.col("dir") == "out"
    return rows.dropDuplicates(["node", "id"]).select("node", "peer", "gain", "step", F.col("id").alias("edge"), "type", F.when(out, F.col("node")).otherwise(F.col("peer")).alias("src"), F.when(out, F.col("peer")).otherwise(F.col("node")).alias("dst"))


#: Questions that start from the same nodes share a spread if they are as many.
SHARED = 8
#: Traces that a task takes in.
ROWS = 1 << 20


def spread(seeds: DataFrame, edges: DataFrame, options: Options | None = None, *, paths: bool = True) -> DataFrame:
    """The best trace of each (query, node, seed): activation, depth, hops, path (its edges, if ``paths``) and truncated, from rows (query, seed, node, score).

    Only traces of at least precision / seeds activation go on, of .01 at least where they can multiply.  Equal activations: less depth, then
    the lesser parent and edge.  With a budget each query expands its frontier in order of activation, node and seed as far
    as links and nodes paid for allow; without one everything is expanded, once for all questions of equal start and floor.
    """
    o = (options or Options()).clamped()
    counts = seeds.groupBy("query").agg(F.countDistinct("seed").alias("n_seeds"))
    least = F.lit(o.precision) / F.col("n_seeds")
    if o.hops > 1:
        least = F.greatest(least, F.lit(LEAST_ACTIVATION))
    floors = counts.select("query", F.greatest(least, F.lit(EPSILON)).alias("floor"))
    start = seeds.groupBy("query", "node", "seed").agg(F.max("score").alias("activation")).join(floors, "query")
    key, hot = ["query", "seed"], None
    if o.budget is None:
        own = cut(start.groupBy(*key, "floor").agg(F.array_sort(F.collect_list(F.struct("node", "activation"))).alias("starts")))
        hot = small(own.groupBy("starts", "floor").agg(F.count("*").alias("n"), F.min(F.struct(*key)).alias("r")).where(F.col("n") >= SHARED).select("starts", "floor", F.col("r.query").alias("rq"), F.col("r.seed").alias("rs")))
        if hot.isEmpty():
            hot = None
        else:
            own = cut(own.join(hot, ["starts", "floor"], "left"))
            first = F.col("rq").isNull() | ((F.col("rq") == F.col("query")) & (F.col("rs") == F.col("seed")))
            start = own.where(first).select(*key, "floor", F.explode("starts").alias("s")).select(*key, "floor", "s.*")
    best = cut(start.select(
        *key, "node", "activation", F.lit(0).alias("hops"), F.lit(0).alias("depth"), "floor", F.lit(False).alias("truncated"),
        *([F.array().cast("array<struct<edge:string,src:string,type:string,dst:string>>").alias("path")] if paths else []),
    ))
    edge = F.struct("edge", "src", "type", "dst")
    named = paths or o.budget is not None
    everywhere = cut(links(edges, o)) if o.budget is not None else None
    fan = everywhere.groupBy("node").agg((F.count("*") + 1).alias("price")) if o.budget is not None else None
    frontier, spent = best, None
    for hop in range(1, o.hops + 1):
        if o.budget is not None:
            order = Window.partitionBy("query").orderBy(F.desc("activation"), "node", "seed")
            priced = frontier.join(fan, "node", "left").withColumn("price", F.coalesce("price", F.lit(1)))
            before = F.coalesce(F.sum("price").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            priced = priced.withColumn("before", before)
            if spent is not None:
                priced = priced.join(spent, "query", "left").withColumn("before", F.col("before") + F.coalesce("spent", F.lit(0))).drop("spent")
            priced = cut(priced)
            used = priced.where(F.col("before") < o.budget).groupBy("query").agg(F.sum("price").alias("now"))
            spent = used.withColumnRenamed("now", "spent") if spent is None else spent.join(used, "query", "full_outer").select("query", (F.coalesce("spent", F.lit(0)) + F.coalesce("now", F.lit(0))).alias("spent"))
            spent = cut(spent)
            over = spent.where(F.col("spent") >= o.budget).select("query", F.lit(True).alias("over"))
            best = best.join(over, "query", "left").withColumn("truncated", F.col("truncated") | F.coalesce("over", F.lit(False))).drop("over")
            frontier = priced.where(F.col("before") < o.budget).drop("price", "before")
        near = links(edges, o, frontier.select("node"), named=named) if everywhere is None else everywhere
        # One of a node's traces stays: the most active, of equals that of fewer hops, then less depth, the lesser parent and edge.
        trace = lambda a, hops, depth, parent, edge, path: F.struct((-a).alias("a"), hops.alias("hops"), depth.alias("depth"), *([parent.alias("parent"), edge.alias("edge")] if paths else []), "floor", "truncated", *([path.alias("path")] if paths else [])).alias("t")
        none = F.lit(None).cast("string")
        held = best.select(*key, "node", trace(F.col("activation"), F.col("hops"), F.col("depth"), none, none, F.col("path") if paths else none))
        reached = frontier.join(near, "node").withColumn("gained", F.col("activation") * F.col("gain")).where("gained >= floor")
        reached = reached.select(*key, F.col("peer").alias("node"), trace(F.col("gained"), F.lit(hop), F.col("depth") + F.col("step"), F.col("node"), F.col("edge") if paths else none, F.concat("path", F.array(edge)) if paths else none))
        merged = held.unionByName(reached).groupBy(*key, "node").agg(F.min("t").alias("t"))
        best = cut(merged.select(*key, "node", (-F.col("t.a")).alias("activation"), "t.hops", "t.depth", "t.floor", "t.truncated", *(["t.path"] if paths else [])))
        frontier = best.where(F.col("hops") == hop)
        if hop == o.hops or frontier.isEmpty():
            break
    what = ["node", "activation", "depth", "hops", "floor", *(["path"] if paths else []), "truncated"]
    if hot is None:
        return best.select(*key, *what)
    shared = best.join(hot.select(F.col("rq").alias("query"), F.col("rs").alias("seed"), F.lit(True).alias("__hot")), key, "left")
    lists = small(shared.where("__hot").groupBy(F.col("query").alias("rq"), F.col("seed").alias("rs")).agg(F.collect_list(F.struct(*what)).alias("__many")), 1 << 12)
    cold = shared.where("__hot is null").select(*key, F.struct(*what).alias("__one"), none.alias("rq"), none.alias("rs"))
    asked = own.where("rq is not null").select(*key, F.lit(None).cast(cold.schema["__one"].dataType).alias("__one"), "rq", "rs")
    sized = lists.select("rq", "rs", F.size("__many").alias("n"))
    n = shared.where("__hot is null").count() + (own.join(sized, ["rq", "rs"]).agg(F.sum("n")).first()[0] or 0)
    parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS))  # by the rows that the lists become
    rows = cold.unionByName(asked).repartition(parts, "query").join(lists, ["rq", "rs"], "left")
    return rows.select(*key, F.explode(F.coalesce("__many", F.array("__one"))).alias("__t")).select(*key, "__t.*")


def associations(traces: DataFrame, seeds: DataFrame, options: Options | None = None) -> DataFrame:
    """Ranked associations of each query: node, score, novelty, distance, source_count, bridge, sources, via, rank.

    Novelty is score * d / (d + 1) * the share of seeds that reach the node, 0 for a seed.  Order: score, then sources (both falling), distance, node.
    """
    o = (options or Options()).clamped()
    asked = seeds.groupBy("query").agg(F.countDistinct("seed").alias("n_seeds"), F.collect_set("node").alias("own"))
    path = F.col("path") if "path" in traces.columns else F.lit(None).cast("array<struct<edge:string,src:string,type:string,dst:string>>").alias("path")
    out = traces.groupBy("query", "node").agg(
        noisy_or(F.col("activation")).alias("raw"), F.min("depth").alias("distance"), F.count("*").alias("source_count"),
        F.array_sort(F.collect_list(F.struct((-F.col("activation")).alias("a"), "seed", "hops", path))).alias("s"),
    )
    out = out.where((F.col("source_count") >= o.min_sources) & (F.col("raw") >= o.precision)).join(asked, "query")
    if not o.include_seeds:
        out = out.where(~F.array_contains("own", F.col("node")))
    d = F.col("distance")
    novelty = F.when(d < 1, 0.0).otherwise(round6(F.col("raw") * (d / (d + 1)) * F.least(F.lit(1.0), F.col("source_count") / F.col("n_seeds"))))
    out = out.select(
        "query", "node", round6(F.col("raw")).alias("score"), novelty.alias("novelty"), "distance", "source_count", (F.col("source_count") > 1).alias("bridge"),
        F.transform("s", lambda x: F.struct(x["seed"].alias("seed"), round6(-x["a"]).alias("activation"), x["hops"].alias("hops"))).alias("sources"),
        F.slice(F.col("s")[0]["path"], 1, 7).alias("via"),
    )
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.desc("source_count"), "distance", "node"))
    out = out.withColumn("rank", rank)
    return out if o.limit is None else out.where(F.col("rank") <= o.limit)


def recall(asked: DataFrame, nodes: DataFrame, edges: DataFrame, options: Options | None = None, *, shortcuts: DataFrame | None = None) -> DataFrame:
    """Associations of queries (query, seed): resolved, spread, ranked.

    ``shortcuts`` (src, dst, score) are remembered links: peers of resolved nodes join the frontier with the product of both scores.
    """
    o = (options or Options()).clamped()
    seeds = cut(resolve(asked, nodes, edges, o))
    start = seeds.select("query", "seed", "node", "score")
    if shortcuts is not None:
        start = start.unionByName(seeds.join(shortcuts.select(F.col("src").alias("node"), "dst", F.col("score").alias("s")), "node").select("query", "seed", F.col("dst").alias("node"), (F.col("score") * F.col("s")).alias("score")))
        start = start.groupBy("query", "seed", "node").agg(F.max("score").alias("score"))
    return associations(spread(start, edges, o), seeds, o)


def recall_exact(asked: DataFrame, edges: DataFrame, options: Options | None = None, *, paths: bool = True) -> DataFrame:
    """The same for seeds that are node ids: the bulk form, without resolution; ``via`` is null without ``paths``."""
    seeds = asked.select("query", "seed", F.col("seed").alias("node"), F.lit(1.0).alias("score")).distinct()
    return associations(spread(seeds, edges, options, paths=paths), seeds, options)


def merged_batches(parts: DataFrame) -> DataFrame:
    """Associations of batches of seeds (node, score, source_count) as one: noisy-or of scores, sum of sources, best first."""
    out = parts.groupBy("node").agg(round6(noisy_or(F.col("score"))).alias("score"), F.sum("source_count").alias("source_count"))
    return out.orderBy(F.desc("score"), F.desc("source_count"), "node")


def counters(traces: DataFrame, found: DataFrame) -> DataFrame:
    """Per query: nodes visited, traces, associations, bridges and whether the budget cut the spread short."""
    a = traces.groupBy("query").agg(F.countDistinct("node").alias("visited"), F.count("*").alias("traces"), F.bool_or("truncated").alias("truncated"))
    b = found.groupBy("query").agg(F.count("*").alias("associations"), F.count(F.when(F.col("bridge"), 1)).alias("bridges"))
    return a.join(b, "query", "left").fillna(0, ["associations", "bridges"])


# Evidence and decay.


def sentence_cut(text: Column, most: int = 4096) -> Column:
    """At most so many characters, cut behind the last sentence's end among them, if there is one."""
    head = F.substring(text, 1, most)
    whole = F.regexp_extract(head, r"(?s)^(.*[.!?])", 1)
    return F.when(F.length(text) <= most, text).when(whole != "", whole).otherwise(head)


def evidence(found: DataFrame, nodes: DataFrame, sentences: DataFrame, *, references: int = 256) -> DataFrame:
    """Associations with their labels and reference sentences; at most ``references`` sentences a query, in order of rank, ordinal and ref."""
    found = small(found)
    said = found.select("query", "node", "rank").join(sentences, "node")
    order = Window.partitionBy("query").orderBy("rank", "ordinal", "ref")
    said = said.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= references)
    said = said.groupBy("query", "node").agg(F.array_sort(F.collect_list(F.struct("ordinal", "ref", sentence_cut(F.col("text")).alias("text")))).alias("references"))
    return found.join(nodes.select(F.col("id").alias("node"), "labels"), "node", "left").join(said, ["query", "node"], "left")


def relation_factors(decay: DataFrame) -> DataFrame:
    """(relation, factor) of a prediction table (key, value, score) that has both carry and stop: .5 plus the softmax share of carry."""
    both = decay.where("key <> ''").groupBy("key").agg(F.max(F.when(F.col("value") == "carry", F.col("score"))).alias("c"), F.max(F.when(F.col("value") == "stop", F.col("score"))).alias("s"))
    share = 1 / (1 + F.exp(F.col("s") - F.col("c")))
    return both.where("c is not null and s is not null").select(F.col("key").alias("relation"), F.least(F.greatest(0.5 + share, F.lit(0.5)), F.lit(1.5)).alias("factor"))


def decay_digest(factors: Mapping[str, float]) -> str:
    """16 hex digits that name a set of factors, whatever its order."""
    import hashlib

    h = hashlib.sha256()
    for relation in sorted(factors):
        raw = relation.encode()
        h.update(f"{len(raw)}:".encode() + raw + f"={factors[relation]:.6f}\n".encode())
    return h.hexdigest()[:16]


# Similarity.


def common(asked: DataFrame, edges: DataFrame, *, direction: str, precision: float, also: DataFrame | None = None, listed: bool = True) -> DataFrame:
    """Pairs (id, candidate) of asked nodes and others with neighbours in common: context, shared_count and shared, their 8 least if ``listed``.

    Those whose share of the asked node's own neighbours is under the precision can't have that context, and are left out where ``also`` (id,
    candidate) doesn't name them.  Nodes are numbered in order; a neighbour's nodes go as one list to each asked one among them, and are counted where they
    arrive, the lists in pieces if few are asked.
    """
    spark = edges.sparkSession
    ends = edges.select("src", "dst").where("src <> dst")
    ids = ends.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    names = cut(numbered(ids.withColumn("__g", F.lit(0)), "__g", "id", "n").select("id", F.col("n").cast("int").alias("n")))
    name = lambda column, n: names.select(F.col("id").alias(column), F.col("n").alias(n))
    ends = ends.join(name("src", "a"), "src").select("a", "dst").join(name("dst", "b"), "dst").select("a", "b")
    if direction == "both":
        ends = cut(ends.select(F.least("a", "b").alias("node"), F.greatest("a", "b").alias("peer")).distinct())
        near = ends.unionByName(ends.select(F.col("peer").alias("node"), F.col("node").alias("peer")))
    else:
        near = cut(ends.select(*((F.col("a").alias("node"), F.col("b").alias("peer")) if direction == "out" else (F.col("b").alias("node"), F.col("a").alias("peer")))).distinct())
    sizes = cut(near.groupBy("node").agg(F.count("*").alias("size")))
    own = cut(asked.join(names, "id").select(F.col("n").alias("node")).join(sizes, "node"))
    n = own.count()
    pieces = max(1, -(-4 * int(spark.conf.get("spark.sql.shuffle.partitions")) // max(n, 1)))
    own = F.broadcast(own) if n <= 1 << 17 else own
    told = F.when(F.col("size").isNotNull(), F.struct(F.col("node").alias("id"), F.col("size").alias("a")))
    lists = near.join(own, "node", "left").groupBy("peer").agg(F.collect_list("node").alias("nodes"), F.collect_list(told).alias("own"))
    rows = lists.where(F.size("own") > 0).select(F.explode("own").alias("o"), "nodes").select("o.*", "nodes")
    if pieces > 1:
        rows = rows.select("id", "a", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("piece"), "nodes")
        rows = rows.withColumn("nodes", F.filter("nodes", lambda x: x % pieces == F.col("piece"))).where(F.size("nodes") > 0)
    key = ["id", "a", "piece"] if pieces > 1 else ["id", "a"]
    pairs = rows.repartition(*key).select(*key, F.explode("nodes").alias("candidate")).where("candidate <> id").groupBy(*key, "candidate").agg(F.count("*").alias("shared_count"))
    most = F.col("shared_count") / F.col("a")
    if also is not None:
        also = also.join(name("id", "i"), "id").join(name("candidate", "c"), "candidate").select(F.col("i").alias("id"), F.col("c").alias("candidate"), F.lit(True).alias("also"))
        pairs = pairs.join(small(also), ["id", "candidate"], "left").where((most >= precision) | F.col("also"))
    else:
        pairs = pairs.where(most >= precision)
    pairs = small(pairs.select("id", "candidate", "a", "shared_count"))
    context = F.col("shared_count") / (F.col("a") + F.coalesce("size", F.lit(0)) - F.col("shared_count"))
    pairs = pairs.join(sizes.withColumnRenamed("node", "candidate"), "candidate", "left").withColumn("context", context)
    pairs = small(pairs if also is not None else pairs.where(F.col("context") >= precision))
    out = pairs.select(F.col("id").alias("i"), F.col("candidate").alias("c"), "context", "shared_count")
    if listed:
        both = pairs.select("id", "candidate").join(near.select(F.col("node").alias("candidate"), "peer"), "candidate")
        both = both.join(near.join(own.select("node"), "node", "left_semi").withColumnRenamed("node", "id"), ["id", "peer"], "left_semi")
        least = F.row_number().over(Window.partitionBy("id", "candidate").orderBy("peer"))
        both = small(both.withColumn("__r", least).where(F.col("__r") <= 8).drop("__r"))
        some = both.join(name("shared", "peer"), "peer").groupBy(F.col("id").alias("i"), F.col("candidate").alias("c")).agg(F.array_sort(F.collect_list("shared")).alias("shared"))
        out = small(out.join(some, ["i", "c"], "left"))
    else:
        out = out.withColumn("shared", F.lit(None).cast("array<string>"))
    return small(out.join(name("id", "i"), "i")).join(name("candidate", "c"), "c").select("id", "candidate", "context", "shared_count", "shared")


def similar(asked: DataFrame, nodes: DataFrame, edges: DataFrame, *, by: str = "all", limit: int | None = 32, precision: float = 0.05, direction: str = "both", tokened: DataFrame | None = None, listed: bool = True) -> DataFrame:
    """Nodes like those asked for (id): id, candidate, score, context, lexical, shared_count, shared.

    Context is the Jaccard of neighbour sets, found by the neighbours in common; lexical the weighted score of common id tokens; together a
    noisy-or.  ``shared`` are the 8 least neighbours in common, none unless ``listed``.  Best first, ties by candidate; ``limit`` of each id.
    """
    asked = small(asked.select("id").distinct())
    scores = pairs = None
    if by in ("lexical", "all"):
        tokened = terms.node_tokens(nodes) if tokened is None else tokened
        documents = tokened.agg(F.count("*").alias("documents"))
        words = small(asked.select("id", F.explode(terms.tokens(F.col("id"))).alias("token")))
        meant = small(words.select("token").distinct())
        posted = terms.postings_of(tokened, meant)
        weights = small(words.join(terms.frequencies(posted), "token", "left").crossJoin(F.broadcast(documents)).select(
            F.col("id").alias("query"), "token", terms.idf(F.col("documents"), F.coalesce("df", F.lit(0))).alias("weight")
        ))
        bare = nodes.select(F.col("id").alias("candidate"), terms.tokens(F.col("id")).alias("tokens"))
        scores = cut(terms.weighted_score(weights, bare).where("query <> candidate").select(F.col("query").alias("id"), "candidate", F.col("score").alias("lexical")))
    if by in ("context", "all"):
        pairs = common(asked, edges, direction=direction, precision=precision, also=None if scores is None else scores.select("id", "candidate"), listed=listed)
    if scores is not None:
        pairs = scores if pairs is None else pairs.join(scores, ["id", "candidate"], "full_outer")
    for name in ("context", "lexical"):
        pairs = pairs.withColumn(name, F.coalesce(name, F.lit(0.0)) if name in pairs.columns else F.lit(0.0))
    count = F.coalesce("shared_count", F.lit(0)).cast("long") if "shared_count" in pairs.columns else F.lit(0).cast("long")
    some = F.coalesce("shared", F.array().cast("array<string>")) if "shared" in pairs.columns else F.array().cast("array<string>")
    score = 1 - (1 - F.col("context")) * (1 - F.col("lexical"))
    out = pairs.withColumn("raw", score).where((F.col("raw") >= precision) & (F.col("raw") > 0)).select(
        "id", "candidate", round6(F.col("raw")).alias("score"), round6(F.col("context")).alias("context"), round6(F.col("lexical")).alias("lexical"), count.alias("shared_count"), some.alias("shared")
    )
    if limit is None:
        return out
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "candidate"))
    return out.withColumn("__r", rank).where(F.col("__r") <= limit).drop("__r")
