"""The property graph: nodes, edges with belief, their upserts as folds, neighbourhoods and graph statistics.

``nodes``: id, labels array<string>, props (JSON), created_at, updated_at.
``edges``: id, src, dst, type, directed, weight, confidence, modality, ambiguity, props (JSON).
An edge's identity is (src, dst, type, directed); traversal is along src to dst whatever ``directed`` says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import belief
from ..functions.literals import b64url, edge_id, round6
from ..plans.lineage import flagged, sieve

LIMIT, LIMIT_MOST = 128, 2048
CLEAR = "-"
#: Rows that a task sorts, but for a node's own.
SORTED = 1 << 20


def page_limit(limit: int) -> int:
    return LIMIT if limit <= 0 else min(limit, LIMIT_MOST)


def tidy_labels(labels: Column) -> Column:
    """Trimmed, without empty ones, distinct, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(labels, lambda x: F.trim(x)), lambda x: x != "")))


def upsert_nodes(log: DataFrame) -> DataFrame:
    """Nodes that a log (seq, at, id, labels, props) leaves: a null field keeps the last value set, props are replaced as a whole."""
    keep = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    out = log.groupBy("id").agg(keep("labels").alias("labels"), keep("props").alias("props"), F.min("at").alias("created_at"), F.max("at").alias("updated_at"))
    return out.withColumns({"labels": F.coalesce(tidy_labels(F.col("labels")), F.array().cast("array<string>")), "props": F.coalesce("props", F.lit("{}"))})


def reference_sentences(refs: DataFrame, most: int = 64, longest: int = 4096) -> DataFrame:
    """Sentences of nodes (node, ref, text, source, ordinal): a missing id is ref_ and 20 hex digits of SHA-256; one of each id; the first 64 by ordinal and id."""
    named = refs.where(F.trim("text") != "").withColumn("text", F.substring(F.trim("text"), 1, longest))
    named = named.withColumn("ref", F.coalesce(F.when(F.trim("ref") != "", F.trim("ref")), F.concat(F.lit("ref_"), F.substring(F.sha2("text", 256), 1, 20))))
    one = named.groupBy("node", "ref").agg(F.min(F.struct("ordinal", "text", "source")).alias("r")).select("node", "ref", "r.*")
    return one.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy("ordinal", "ref"))).where(F.col("n") <= most).drop("n")


def upsert_edges(log: DataFrame) -> DataFrame:
    """Edges that a log (seq, src, dst, type, directed, weight, confidence, modality, ambiguity, props) leaves.

    A write without weight sets it to 1; null props, confidence, modality and ambiguity keep what was set, ``-`` as modality or
    ambiguity clears it, and a modality of ``-`` the confidence as well.  Of confidence and modality a missing one follows from the other.
    """
    given = F.coalesce(F.col("confidence"), belief.confidence_of(F.col("modality")))
    word = F.coalesce(belief.canonical(F.col("modality")), belief.modality_of(F.col("confidence")))
    clears = F.col("modality") == CLEAR
    said = F.col("confidence").isNotNull() | F.col("modality").isNotNull()
    log = log.withColumns({"__b": F.struct(F.when(~F.coalesce(clears, F.lit(False)), given).alias("c"), F.when(~F.coalesce(clears, F.lit(False)), word).alias("m")), "__said": said})
    keep = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    out = log.groupBy("src", "dst", "type", "directed").agg(
        F.max_by(F.coalesce("weight", F.lit(1.0)), "seq").alias("weight"),
        F.max_by("__b", F.when(F.col("__said"), F.col("seq"))).alias("__b"),
        keep("ambiguity").alias("ambiguity"),
        keep("props").alias("props"),
    )
    return out.select(
        edge_id(F.col("src"), F.col("type"), F.col("dst"), F.col("directed")).alias("id"), "src", "dst", "type", "directed", "weight",
        F.col("__b.c").alias("confidence"), F.col("__b.m").alias("modality"), F.when(F.col("ambiguity") != CLEAR, F.col("ambiguity")).alias("ambiguity"), F.coalesce("props", F.lit("{}")).alias("props"),
    )


def batch_status(items: DataFrame, existing: DataFrame, *, continue_on_error: bool = False) -> DataFrame:
    """requested, applied, created, updated and failed of a batch of edges (idx, src, dst, type, directed)."""
    bad = ~(F.coalesce(F.trim("src") != "", F.lit(False)) & F.coalesce(F.trim("dst") != "", F.lit(False)))
    items = items.withColumn("bad", bad)
    stop = items.where("bad").agg(F.min("idx").alias("stop"))
    items = items.crossJoin(F.broadcast(stop))
    ran = F.lit(True) if continue_on_error else F.col("stop").isNull() | (F.col("idx") < F.col("stop"))
    key = ["src", "dst", "type", "directed"]
    first = F.row_number().over(Window.partitionBy(*key).orderBy("idx")) == 1
    there = existing.select(*key).distinct().withColumn("there", F.lit(True))
    rows = items.withColumn("applied", ran & ~F.col("bad")).join(there, key, "left").withColumn("new", first & F.col("there").isNull())
    return rows.agg(
        F.count("*").alias("requested"), F.count(F.when(F.col("applied"), 1)).alias("applied"), F.count(F.when(F.col("applied") & F.col("new"), 1)).alias("created"),
        F.count(F.when(F.col("applied") & ~F.col("new"), 1)).alias("updated"), F.count(F.when(F.col("bad"), 1)).alias("failed"),
    )


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def stubs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids that edges name and nodes lack: what autocreate adds, and what its absence refuses."""
    return endpoints(edges).join(nodes.select("id"), "id", "left_anti")


def delete_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame, *, cascade: bool = False) -> tuple[DataFrame, DataFrame]:
    """Without cascade the edges stay, dangling."""
    gone = ids.select("id").distinct()
    left = nodes.join(gone, "id", "left_anti")
    if not cascade:
        return left, edges
    # A sieve says of most edges that both ends stay; only the others are asked for exactly.
    bits = sieve(gone, "id")
    told = flagged(flagged(edges, "src", bits, "__a"), "dst", bits, "__b")
    kept, open_ = told.where("not __a and not __b").drop("__a", "__b"), told.where("__a or __b").drop("__a", "__b")
    for end in ("src", "dst"):
        open_ = open_.join(gone.withColumnRenamed("id", end), end, "left_anti")
    return left, kept.unionByName(open_.select(*edges.columns))


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("src", "dst", "type", "directed").distinct(), ["src", "dst", "type", "directed"], "left_anti")


# Ambiguity: alternatives of one source that share a probability.


def distribute(options: DataFrame, *, group: list[str], normalize: bool = True) -> DataFrame:
    """Confidence and modality of options (share null where not declared): undeclared ones are all equal, or get equal parts of what
    the declared leave of 1, or (if those aren't probabilities) their mean; then all are scaled to sum 1."""
    w = Window.partitionBy(*group)
    n, declared = F.count("*").over(w), F.count("share").over(w)
    total, top = F.coalesce(F.sum("share").over(w), F.lit(0.0)), F.coalesce(F.max("share").over(w), F.lit(0.0))
    implicit = (
        F.when(declared == 0, F.lit(1.0) / n)
        .when((total <= 1) & (top <= 1), (1 - total) / F.when(n > declared, n - declared))
        .otherwise(total / F.when(declared > 0, declared))
    )
    implicit = F.when(implicit > 0, implicit).otherwise(F.lit(1.0) / n)
    out = options.withColumn("__s", F.coalesce("share", implicit))
    if normalize:
        whole = F.sum("__s").over(w)
        out = out.withColumn("confidence", F.when(whole > 0, round6(F.col("__s") / whole)).otherwise(round6(F.lit(1.0) / n)))
    else:
        out = out.withColumn("confidence", F.col("__s"))
    return out.withColumn("modality", belief.modality_of(F.col("confidence"))).drop("__s")


def above_one(options: DataFrame) -> DataFrame:
    """Options that without normalising would not be confidences."""
    return options.where("confidence > 1 or confidence < 0")


def ambiguity(edges: DataFrame) -> DataFrame:
    """Of each (src, ambiguity): members, sum of confidences, the top option (ties: least dst) and its modality."""
    c = belief.effective_confidence(F.col("confidence"))
    rows = edges.where("ambiguity is not null").withColumn("__c", c)
    best = F.min(F.struct((-F.col("__c")).alias("c"), "dst", belief.effective_modality(F.col("modality"), F.col("confidence")).alias("m"))).alias("b")
    return rows.groupBy("src", "ambiguity").agg(F.count("*").alias("options"), F.sum("__c").alias("confidence_sum"), best).select(
        "src", "ambiguity", "options", "confidence_sum", F.col("b.dst").alias("top"), F.col("b.m").alias("top_modality")
    )


def resolve_ambiguity(edges: DataFrame, winners: DataFrame, *, drop: bool = False) -> DataFrame:
    """Winners (src, ambiguity, winner) become certain, their rivals ruled out or dropped; resolved groups dissolve."""
    joined = edges.join(winners, ["src", "ambiguity"], "left")
    open_, won = F.col("winner").isNull(), F.col("dst") == F.col("winner")
    if drop:
        joined = joined.where(open_ | won)
    out = joined.withColumns({
        "confidence": F.when(open_, F.col("confidence")).when(won, F.lit(1.0)).otherwise(F.lit(0.0)),
        "modality": F.when(open_, F.col("modality")).when(won, F.lit("certain")).otherwise(F.lit("ruled_out")),
        "ambiguity": F.when(open_, F.col("ambiguity")),
    })
    return out.select(*edges.columns)


# Neighbourhoods.


def adjacency(edges: DataFrame, direction: str = "out") -> DataFrame:
    """Edges as (node, peer, dir, ...): out by src, in by dst, both one after the other."""
    if direction == "both":
        return adjacency(edges, "out").unionByName(adjacency(edges, "in"))
    node, peer = ("src", "dst") if direction == "out" else ("dst", "src")
    return edges.withColumns({"node": F.col(node), "peer": F.col(peer), "dir": F.lit(direction)})


def adjacency_order() -> list[Column]:
    return [b64url(F.col("type")), b64url(F.col("peer")), F.col("directed")]


def neighbors(edges: DataFrame, node: str, *, direction: str = "out", type: str = "*", limit: int = 0) -> DataFrame:  # noqa: A002
    """A node's edges, in adjacency order; both directions deduplicated by edge and in order of (src, type, dst)."""
    rows = edges if type == "*" else edges.where(F.col("type") == type)
    if direction == "both":
        rows = rows.where((F.col("src") == node) | (F.col("dst") == node)).dropDuplicates(["id"]).orderBy("src", "type", "dst")
    else:
        rows = adjacency(rows, direction).where(F.col("node") == node).orderBy(*adjacency_order()).drop("node", "peer", "dir")
    return rows.limit(page_limit(limit))


def degree(edges: DataFrame, *, direction: str = "out", type: str = "*", weighted: bool = False) -> DataFrame:  # noqa: A002
    """Degree (and weight) of every node; both is out plus in, a loop counting twice."""
    rows = adjacency(edges if type == "*" else edges.where(F.col("type") == type), direction)
    measures = [F.count("*").alias("degree")] + ([F.sum("weight").alias("weight")] if weighted else [])
    return rows.groupBy("node").agg(*measures)


def neighbor_types(edges: DataFrame, *, direction: str = "out", limit: int | None = None) -> DataFrame:
    """Histogram of the types at every node; with a limit, of each node's first rows in adjacency order."""
    rows = adjacency(edges, direction)
    if limit is not None:
        first = Window.partitionBy("node", "dir").orderBy(*adjacency_order())
        n = edges.count() * (2 if direction == "both" else 1)
        parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // SORTED))
        rows = rows.select("node", "dir", "peer", "type", "directed", "weight").repartition(parts, "node").withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= page_limit(limit))
    rows = rows.where("type is not null and type <> ''")
    return rows.groupBy("node", "type").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


# Reducers over adjacency.


def reduce_degree(page: DataFrame) -> DataFrame:
    return page.groupBy("dir", "node", "type").agg(F.count("*").alias("degree"))


#: Neighbours up to which an anchor's pairs are looked up one by one.
LIGHT = 12


def reduce_triangles(page: DataFrame, edges: DataFrame) -> DataFrame:
    """Per anchor: distinct neighbours, the pairs of them that an edge closes, and the clustering coefficient.

    Anchors of up to LIGHT neighbours have few pairs, which are looked up among the links: LIGHT / 2 rows an edge at most.  The others are so
    few that a link is extended to those at one of its ends, the end that has fewer, and then looked up at the other.
    """
    near = page.select("node", "peer").distinct()
    near = near.join(near.groupBy("node").agg(F.count("*").alias("neighbors")), "node")
    linked = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a < b").distinct()
    own = near.where(f"neighbors between 2 and {LIGHT}").groupBy("node").agg(F.array_sort(F.collect_list("peer")).alias("peers"))
    wedges = own.select("node", "peers", F.posexplode("peers").alias("at", "a")).select("node", "a", F.explode(F.slice("peers", F.col("at") + 2, LIGHT)).alias("b"))
    few = wedges.join(linked, ["a", "b"]).select("node")
    heavy = near.where(f"neighbors > {LIGHT}").select("node", "peer")
    anchors = heavy.groupBy("peer").agg(F.count("*").alias("n"))
    ends = linked.join(anchors.select(F.col("peer").alias("a"), F.col("n").alias("n_a")), "a").join(anchors.select(F.col("peer").alias("b"), F.col("n").alias("n_b")), "b")
    fewer = F.col("n_a") <= F.col("n_b")
    ends = ends.select(F.when(fewer, F.col("a")).otherwise(F.col("b")).alias("peer"), F.when(fewer, F.col("b")).otherwise(F.col("a")).alias("other"))
    many = ends.join(heavy, "peer").select("node", F.col("other").alias("peer")).join(heavy, ["node", "peer"]).select("node")
    closed = few.unionByName(many).groupBy("node").agg(F.count("*").alias("closed"))
    n = near.select("node", "neighbors").distinct()
    whole = F.col("neighbors") * (F.col("neighbors") - 1) / 2
    return n.join(closed, "node", "left").select("node", "neighbors", F.coalesce("closed", F.lit(0)).alias("closed"), F.when(whole > 0, F.coalesce("closed", F.lit(0)) / whole).otherwise(0.0).alias("coefficient"))


def reduce_pagerank_seed(page: DataFrame, edges: DataFrame, *, limit: int | None = None) -> DataFrame:
    """Anchors and neighbours of the page, scored (in + 1) / (out + 1) over the whole graph; best first, then by node."""
    who = page.select(F.explode(F.array("node", "peer")).alias("node")).distinct()
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("outs"))
    in_ = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("ins"))
    outs, ins = F.coalesce("outs", F.lit(0)), F.coalesce("ins", F.lit(0))
    rows = who.join(out, "node", "left").join(in_, "node", "left").select("node", ins.alias("ins"), outs.alias("outs"), ((ins + 1) / (outs + 1)).alias("score"))
    return rows if limit is None else rows.orderBy(F.desc("score"), "node").limit(limit)
