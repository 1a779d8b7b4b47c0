"""Pattern queries: a small language, parsed to a plan, built as joins.

    MATCH (id='a')-[:type]->(id='b', label='L') [WHERE p AND p ...] [HOPS n | a..b] [BRANCH_LIMIT n] [COST_LIMIT x]
          [RETURN edges|nodes|paths|count] [LIMIT n]

The left side names an id; ``<-[:type]-`` goes against the edges.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import belief
from ..plans.lineage import passing, sieve, small
from .graph import adjacency_order, page_limit

HOPS_MOST, BRANCH, BRANCH_MOST, READ_LEAST, READ_MOST = 16, 128, 4096, 256, 2048
RANKS = {name: i for i, (name, _) in enumerate(belief.SCALE)}


@dataclass(frozen=True)
class End:
    id: str | None = None  # None: any
    label: str | None = None


@dataclass(frozen=True)
class Predicate:
    scope: str  # edge, from, to
    field: str
    op: str
    value: str | float | bool
    path: tuple[str, ...] = ()


@dataclass(frozen=True)
class Plan:
    left: End
    right: End
    type: str | None
    forward: bool = True
    where: tuple[Predicate, ...] = field(default_factory=tuple)
    least: int = 1
    most: int = 1
    branch: int = BRANCH
    cost: float | None = None
    returns: str = "edges"
    limit: int = 0


def _split(text: str, by: str) -> list[str]:
    """Parts between separators that stand outside quotes."""
    out, at, quote = [], 0, ""
    for m in re.finditer(rf"['\"]|{by}", text, re.I):
        c = m[0]
        if c in "'\"" and len(c) == 1:
            quote = "" if quote == c else (quote or c)
        elif not quote:
            out.append(text[at : m.start()])
            at = m.end()
    return [*out, text[at:]]


def _unquoted(text: str) -> str:
    text = text.strip()
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"" else text


def _end(text: str) -> End:
    text = text.strip()
    if text == "*":
        return End()
    if "=" not in text:
        if not _unquoted(text):
            raise ValueError("invalid_id")
        return End(_unquoted(text))
    got: dict[str, str] = {}
    for part in _split(text, ","):
        key, eq, value = part.partition("=")
        key = key.strip().lower()
        if not eq or key not in ("id", "label"):
            raise ValueError(f"unsupported_node_field:{key}")
        got[key] = _unquoted(value)
    if not got.get("id"):
        raise ValueError("node_id_required")
    return End(None if got["id"] == "*" else got["id"], got.get("label"))


_PREDICATE = re.compile(r"(edge|from|to)\.([a-z_]+)((?:\.[\w-]+)*)\s*(<=|>=|!=|=|<|>)\s*(.+)", re.I | re.S)


def _predicate(text: str) -> Predicate:
    m = _PREDICATE.fullmatch(text.strip())
    if not m:
        raise ValueError(f"invalid_predicate:{text.strip()}")
    scope, name, path, op, raw = m[1].lower(), m[2].lower(), tuple(p for p in m[3].split(".") if p), m[4], m[5].strip()
    word = _unquoted(raw)
    quoted = word != raw
    if scope != "edge":
        if name not in ("id", "label") or op not in ("=", "!="):
            raise ValueError("unsupported_node_predicate")
        return Predicate(scope, name, op, word)
    if name == "props":
        if not path:
            raise ValueError("invalid_prop_path")
        if not quoted and raw.lower() in ("true", "false"):
            if op not in ("=", "!="):
                raise ValueError("invalid_operator")
            return Predicate(scope, "props", op, raw.lower() == "true", path)
        try:
            if not quoted:
                return Predicate(scope, "props", op, float(raw), path)
        except ValueError:
            pass
        if op not in ("=", "!="):
            raise ValueError("invalid_operator")
        return Predicate(scope, "props", op, word, path)
    if name in ("weight", "confidence"):
        if name == "confidence" and word.lower() in belief.CANONICAL:
            return Predicate(scope, name, op, dict(belief.SCALE)[belief.CANONICAL[word.lower()]])
        return Predicate(scope, name, op, float(word))
    if name == "modality":
        if word.lower() not in belief.CANONICAL:
            raise ValueError(f"unknown_modality:{word}")
        return Predicate(scope, name, op, belief.CANONICAL[word.lower()])
    if name in ("type", "ambiguity") and op in ("=", "!="):
        return Predicate(scope, name, op, word)
    raise ValueError("unsupported_edge_predicate")


_MATCH = re.compile(r"\s*MATCH\s*\((.*?)\)\s*(<-|-)\s*\[\s*:?\s*([^\]]*?)\s*\]\s*(->|-)\s*\((.*?)\)\s*(.*)", re.I | re.S)
_CLAUSES = re.compile(r"\b(WHERE|HOPS|BRANCH_LIMIT|COST_LIMIT|RETURN|LIMIT)\b", re.I)


def parse(text: str) -> Plan:
    m = _MATCH.fullmatch(text)
    if not m:
        raise ValueError("invalid_match")
    left, right = _end(m[1]), _end(m[5])
    if left.id is None:
        raise ValueError("left_node_id_required")
    if (m[2], m[4]) not in (("-", "->"), ("<-", "-")):
        raise ValueError("invalid_direction")
    kind = _unquoted(m[3])
    rest, clauses, order = m[6], {}, ["WHERE", "HOPS", "BRANCH_LIMIT", "COST_LIMIT", "RETURN", "LIMIT"]
    cuts, quote = [], ""
    for c in re.finditer(r"['\"]|" + _CLAUSES.pattern, rest, re.I):
        if c[0] in ("'", '"'):
            quote = "" if quote == c[0] else (quote or c[0])
        elif not quote:
            cuts.append(c)
    if rest.strip() and (not cuts or rest[: cuts[0].start()].strip()):
        raise ValueError("invalid_clause")
    last = -1
    for c, n in zip(cuts, [*cuts[1:], None]):
        name = c[0].upper()
        if order.index(name) <= last:
            raise ValueError(f"clause_order:{name}")
        last = order.index(name)
        clauses[name] = rest[c.end() : n.start() if n else len(rest)].strip()
    least, most = 1, 1
    if "HOPS" in clauses:
        h = re.fullmatch(r"(\d+)(?:\s*(?:\.\.|-)\s*(\d+))?", clauses["HOPS"])
        if not h:
            raise ValueError("invalid_hops")
        least, most = (1, int(h[1])) if h[2] is None else (int(h[1]), int(h[2]))
        if not 1 <= least <= most:
            raise ValueError("invalid_hops")
        most = min(most, HOPS_MOST)
    returns = clauses.get("RETURN", "edges").lower()
    if returns not in ("edges", "nodes", "paths", "count"):
        raise ValueError(f"invalid_return:{returns}")
    return Plan(
        left, right, None if kind in ("", "*") else kind, m[2] == "-", tuple(_predicate(p) for p in _split(clauses["WHERE"], r"\bAND\b")) if "WHERE" in clauses else (),
        least, most, min(int(clauses.get("BRANCH_LIMIT", BRANCH)), BRANCH_MOST), float(clauses["COST_LIMIT"]) if "COST_LIMIT" in clauses else None, returns, int(clauses.get("LIMIT", 0)),
    )


def _compare(c: Column, op: str, v: object) -> Column:
    v = F.lit(v)
    return {"=": c == v, "!=": c != v, ">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v}[op]


def property_predicate(p: Predicate, props: Column) -> Column:
    """A predicate on a JSON property.

    A property that isn't there differs from everything and compares no other way.  Equality on a top-level property
    is typed: the number 5 isn't the string "5"; nested paths and other comparisons coerce.
    """
    tree = F.try_parse_json(props)
    path = "$" + "".join(f".{x}" for x in p.path)
    text, there = F.try_variant_get(tree, path, "string"), F.try_variant_get(tree, path, "variant").isNotNull()
    if isinstance(p.value, bool):
        value = F.try_variant_get(tree, path, "boolean") if len(p.path) > 1 or p.op != "=" else F.when(text.isin("true", "false") & (F.schema_of_variant(F.try_variant_get(tree, path, "variant")) == "BOOLEAN"), text == "true")
    elif isinstance(p.value, float):
        number = text.try_cast("double")
        if p.op == "=" and len(p.path) == 1:
            kind = F.schema_of_variant(F.try_variant_get(tree, path, "variant"))
            number = F.when(~kind.isin("STRING", "BOOLEAN"), number)
        value = number
    else:
        value = text
        if p.op == "=" and len(p.path) == 1:
            value = F.when(F.schema_of_variant(F.try_variant_get(tree, path, "variant")) == "STRING", text)
    held = F.coalesce(_compare(value, p.op, p.value), F.lit(False))
    return F.when(there, held).otherwise(F.lit(p.op == "!="))


def edge_predicate(p: Predicate) -> Column:
    if p.field == "props":
        return property_predicate(p, F.col("props"))
    if p.field == "confidence":
        return _compare(belief.effective_confidence(F.col("confidence")), p.op, p.value)
    if p.field == "modality":
        word = belief.effective_modality(F.col("modality"), F.col("confidence"))
        return _compare(word, p.op, p.value) if p.op in ("=", "!=") else _compare(belief.rank(word), p.op, RANKS[p.value])
    return F.coalesce(_compare(F.coalesce(F.col(p.field), F.lit("") if p.field != "weight" else F.lit(1.0)), p.op, p.value), F.lit(False))


def filtered(edges: DataFrame, nodes: DataFrame, plan: Plan) -> DataFrame:
    """Edges of the plan's type that all its predicates allow; label predicates are false where the node isn't there."""
    rows = edges if plan.type is None else edges.where(F.col("type") == plan.type)
    for p in plan.where:
        if p.scope == "edge":
            rows = rows.where(edge_predicate(p))
        else:
            end = "src" if p.scope == "from" else "dst"
            if p.field == "id":
                rows = rows.where(_compare(F.col(end), p.op, p.value))
            else:
                has = F.array_contains("labels", p.value)
                good = nodes.where(has if p.op == "=" else ~has).select(F.col("id").alias(end))
                rows = rows.join(good, end, "left_semi")
    return rows


def _far(rows: DataFrame, nodes: DataFrame, end: End) -> DataFrame:
    if end.id is not None:
        rows = rows.where(F.col("peer") == end.id)
    if end.label is not None:
        rows = rows.join(nodes.where(F.array_contains("labels", end.label)).select(F.col("id").alias("peer")), "peer", "left_semi")
    return rows


EDGE = ("id", "src", "dst", "type", "weight")


def traverse(edges: DataFrame, nodes: DataFrame, plan: Plan, anchors: DataFrame, *, tied: bool = False) -> DataFrame:
    """Edges that the plan's paths from the anchors (column anchor) end with: anchor, hop, cost and the edge, one row per anchor, edge and hop.

    Paths are simple, follow of each node at most ``branch`` edges (heaviest first, then cheapest, then by peer) and cost 1 / weight an
    edge; an edge without positive weight can't be followed.  Every edge of a path passes the predicates.  The far end is asked of the last
    edge only, from the least hop on.  ``tied``: with ``directed``, which orders the edges.
    """
    node, peer = ("src", "dst") if plan.forward else ("dst", "src")
    allowed = filtered(edges, nodes, plan).where("weight > 0").withColumns({"node": F.col(node), "peer": F.col(peer), "step": 1 / F.col("weight")})
    read = min(max(plan.branch, READ_LEAST), READ_MOST)
    frontier = anchors.select("anchor", F.col("anchor").alias("at"), F.array("anchor").alias("path"), F.lit(0.0).alias("cost"))
    out = None
    for hop in range(1, plan.most + 1):
        frontier = small(frontier)
        usable = passing(allowed.select(*EDGE, "directed", "node", "peer", "step"), "node", sieve(frontier, "at"))  # only what is reached is ranked
        if plan.most > 1:
            usable = usable.withColumn("__n", F.row_number().over(Window.partitionBy("node").orderBy(*adjacency_order()))).where(F.col("__n") <= read)
        usable = usable.select(*EDGE, "directed", "node", "peer", "step")
        reached = frontier.join(usable, frontier["at"] == usable["node"]).withColumn("cost", F.col("cost") + F.col("step"))
        if plan.cost is not None:
            reached = reached.where(F.col("cost") <= plan.cost)
        if hop >= plan.least:
            hits = _far(reached, nodes, plan.right).groupBy("anchor", *EDGE, "directed").agg(F.min("cost").alias("cost")).withColumn("hop", F.lit(hop))
            out = hits if out is None else out.unionByName(hits)
        if hop < plan.most:
            fresh = reached.where(~F.array_contains("path", F.col("peer")))
            rank = F.row_number().over(Window.partitionBy("anchor", "path").orderBy(F.desc("weight"), "step", "peer"))
            frontier = fresh.withColumn("__r", rank).where(F.col("__r") <= plan.branch).select("anchor", F.col("peer").alias("at"), F.concat("path", F.array("peer")).alias("path"), "cost")
    return out if tied else out.select("anchor", *EDGE, "cost", "hop")


def match_edges(edges: DataFrame, nodes: DataFrame, plan: Plan) -> DataFrame:
    """The edges a query finds, as it orders and limits them."""
    if plan.most == 1 and plan.cost is None:
        node, peer = ("src", "dst") if plan.forward else ("dst", "src")
        rows = filtered(edges, nodes, plan).withColumns({"node": F.col(node), "peer": F.col(peer)}).where(F.col("node") == plan.left.id)
        if plan.left.label is not None:
            rows = rows.join(nodes.where(F.array_contains("labels", plan.left.label)).select(F.col("id").alias("node")), "node", "left_semi")
        rows = _far(rows, nodes, plan.right).withColumn("hop", F.lit(1))
    else:
        start = nodes.sparkSession.createDataFrame([(plan.left.id,)], "anchor string")
        if plan.left.label is not None:
            start = start.join(nodes.where(F.array_contains("labels", plan.left.label)).select(F.col("id").alias("anchor")), "anchor", "left_semi")
        peer = "dst" if plan.forward else "src"
        rows = traverse(edges, nodes, plan, start, tied=True).withColumn("peer", F.col(peer))
    return rows.orderBy("hop", *adjacency_order()).limit(page_limit(plan.limit)).select(*EDGE, "hop")


def query(edges: DataFrame, nodes: DataFrame, text: str) -> DataFrame:
    """Runs a query: edges or paths (the edges with their hop), nodes (their distinct ends, sorted) or count."""
    plan = parse(text)
    rows = match_edges(edges, nodes, plan)
    if plan.returns == "nodes":
        return rows.select(F.explode(F.array("src", "dst")).alias("node")).distinct().orderBy("node")
    if plan.returns == "count":
        return rows.agg(F.count("*").alias("n"))
    return rows
