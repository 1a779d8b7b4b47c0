"""Databases, commands, batches and jobs: the driver-side layer over the operators.

A command is a name and ``key=value`` arguments; its answer is a DataFrame or a dict.  Writes make new snapshots, so they are meant in bulk:
the operators take whole tables of writes, and ``BATCH`` of a homogeneous command is one such write.
"""

from __future__ import annotations

import json
import re
import shlex
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph, memo, pattern, placement, predict, recall, records, scan, store, terms
from .plans.lineage import cut
from .sources.snapshots import Folder, export_fork, settings_text

BATCH_MOST, PAGE = 10_000, 1000
NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]{0,63}")
Answer = DataFrame | dict
Command = Callable[["Database", dict], Answer]
COMMANDS: dict[str, Command] = {}
ALIASES = {
    "DELETE": "DEL values", "PAIR_DEL": "DEL pairs", "PAIR_PURGE": "DEL pairs", "GRAPH_NODE_DEL": "DEL graph", "GRAPH_EDGE_DEL": "DEL graph",
    "PAIR_REDUCE_ASYNC": "JOB submit PAIR_REDUCE", "PREDICT_INHERIT_ASYNC": "JOB submit PREDICT_INHERIT", "GRAPH_RECALL_ASYNC": "JOB submit GRAPH_RECALL",
    "PAIR_REDUCE_STATUS": "JOB status", "PREDICT_INHERIT_STATUS": "JOB status", "GRAPH_RECALL_STATUS": "JOB status",
    "PAIR_REDUCE_FETCH": "JOB fetch", "PREDICT_INHERIT_FETCH": "JOB fetch", "GRAPH_RECALL_FETCH": "JOB fetch",
}
SUBMITTABLE = ("PAIR_REDUCE", "PREDICT_INHERIT", "GRAPH_RECALL", "BATCH")
UNBATCHED = ("BATCH", "JOB", "DATABASE", "RESET_DB", "EXIT")


def command(name: str) -> Callable[[Command], Command]:
    def add(f: Command) -> Command:
        COMMANDS[name] = f
        return f

    return add


def parse(line: str) -> tuple[str, dict]:
    """A line's command and arguments; words without ``=`` are numbered 0, 1 …"""
    words = shlex.split(line, posix=True)
    if not words:
        raise ValueError("empty_command")
    args: dict = {}
    for w in words[1:]:
        key, eq, value = w.partition("=")
        if eq and re.fullmatch(r"[A-Za-z_][\w.]*", key):
            args[key] = value
        else:
            args[sum(isinstance(k, int) for k in args)] = w
    return words[0].upper(), args


def flag(value: object) -> bool:
    return str(value).strip().lower() in ("1", "true", "yes", "on")


@dataclass
class Job:
    id: str
    command: str
    future: Future
    total: int = 1
    partial: list = field(default_factory=list)

    @property
    def state(self) -> str:
        return "running" if not self.future.done() else "failed" if self.future.exception() else "done"


class Engine:
    """Databases under one folder, each with settings of its own over the engine's."""

    def __init__(self, spark: SparkSession, root: str, **defaults: object) -> None:
        self.spark, self.root, self.defaults = spark, root.rstrip("/"), defaults
        self.topology, self.open, self.lines = placement.Topology(), {}, []
        self.started = time.time()

    def create(self, name: str, **settings: object) -> Database:
        if not NAME.fullmatch(name):
            raise ValueError("invalid_database_name")
        folder = Folder(self.spark, f"{self.root}/{name}")
        folder.save("settings.json", settings_text(settings))
        self.open[name] = Database(self, name, folder)
        return self.open[name]

    def database(self, name: str) -> Database:
        return self.open.get(name) or self.create(name, **json.loads(Folder(self.spark, f"{self.root}/{name}").load("settings.json") or "{}"))

    def configure(self, name: str, **settings: object) -> dict:
        db = self.database(name)
        own = {**json.loads(db.folder.load("settings.json") or "{}"), **settings}
        db.folder.save("settings.json", settings_text({k: v for k, v in own.items() if v is not None}))
        return {**self.defaults, **own}

    def list(self) -> list[dict]:
        names = Folder(self.spark, self.root).listed()
        return [{"name": n, "loaded": n in self.open, **self.defaults, **json.loads(Folder(self.spark, f"{self.root}/{n}").load("settings.json") or "{}")} for n in names]

    def reset(self, name: str) -> None:
        if not NAME.fullmatch(name):
            raise ValueError("invalid_database_name")
        self.open.pop(name, None)
        Folder(self.spark, self.root).drop(name)


class Database:
    def __init__(self, engine: Engine, name: str, folder: Folder) -> None:
        self.engine, self.name, self.folder, self.spark = engine, name, folder, engine.spark
        self.jobs: dict[str, Job] = {}
        self.pool = ThreadPoolExecutor(max_workers=4, thread_name_prefix=f"job-{name}")
        self.lock, self.epoch, self.classes = threading.RLock(), 0, {}

    def table(self, name: str) -> DataFrame:
        return self.folder.table(name)

    def replace(self, name: str, rows: DataFrame) -> None:
        with self.lock:
            self.folder.replace(name, rows)
            if name in ("nodes", "edges", "sentences"):
                self.epoch += 1

    def rows(self, schema: str, *rows: tuple) -> DataFrame:
        return self.spark.createDataFrame(list(rows), schema)

    def execute(self, line: str) -> Answer:
        """Runs a line; errors are ValueErrors whose text is the token."""
        name, args = parse(line)
        if name in ALIASES:
            name, args = parse(f"{ALIASES[name]} {line.split(None, 1)[1] if ' ' in line.strip() else ''}")
        if name not in COMMANDS:
            raise ValueError(f"unknown_command:{name}")
        self.engine.lines.append(f"{self.name} {name}")
        del self.engine.lines[:-1000]
        return COMMANDS[name](self, args)

    def submit(self, line: str) -> Job:
        name, _ = parse(line)
        if name not in SUBMITTABLE:
            raise ValueError("command_not_submittable")
        key = uuid.uuid4().hex

        def work() -> Answer:
            self.spark.sparkContext.setJobGroup(key, line[:80], interruptOnCancel=True)
            out = self.execute(line)
            return out if isinstance(out, dict) else {"rows": out.collect()}

        self.jobs[key] = Job(key, name, self.pool.submit(work))
        return self.jobs[key]


def _limit(args: dict, name: str = "limit", default: int = 0) -> int:
    return int(args.get(name, default))


def _values(db: Database) -> DataFrame:
    return db.table("values")


# Values and names.


@command("INSERT")
def _insert(db: Database, a: dict) -> dict:
    with db.lock:
        new, bad = store.insert(_values(db), db.rows("seq long, payload string", (0, a.get("value", a.get(0, "")))))
        if bad.count():
            raise ValueError("invalid_value_size")
        key = new.first()["key"]
        db.replace("values", _values(db).unionByName(new))
    return {"key": key}


@command("READ")
def _read(db: Database, a: dict) -> DataFrame:
    return store.read(_values(db), db.rows("key long", (int(a.get("key", a.get(0))),)))


@command("EDIT")
def _edit(db: Database, a: dict) -> dict:
    key, payload = int(a.get("key", a.get(0))), a.get("value", a.get(1))
    if not payload:
        raise ValueError("invalid_value_size")
    db.replace("values", store.edit(_values(db), db.rows("key long, seq long, payload string", (key, 0, payload))))
    return {"key": key}


def _pair_set(db: Database, a: dict, hidden: bool) -> dict:
    name, key = a.get("name", a.get(0)), int(a.get("key", a.get(1)))
    if not name:
        raise ValueError("empty_name")
    log = db.table("pairs").withColumn("seq", F.lit(0)).unionByName(db.rows("name string, key long, hidden boolean, seq int", (name, key, hidden, 1)))
    db.replace("pairs", store.upsert_pairs(log))
    return {"name": name, "key": key}


COMMANDS["PAIR_SET"] = lambda db, a: _pair_set(db, a, False)
COMMANDS["PAIR_SET_HIDDEN"] = lambda db, a: _pair_set(db, a, True)
COMMANDS["PAIR_GET"] = lambda db, a: store.get(db.table("pairs"), a.get("name", a.get(0)))


@command("PAIR_PUT_BATCH")
def _pair_put_batch(db: Database, a: dict) -> dict:
    items = json.loads(a["items"]) if isinstance(a["items"], str) else a["items"]
    if len(items) > BATCH_MOST:
        raise ValueError("too_many_items")
    rows = db.rows("idx long, name string, payload string", *[(i, x.get("k"), x.get("v")) for i, x in enumerate(items)])
    with db.lock:
        good = store.put_batch(rows, continue_on_error=flag(a.get("continue_on_error", 0))).where("applied")
        good = good.where(F.octet_length("payload") > 0).select(F.col("idx").alias("seq"), "name", "payload", F.lit(flag(a.get("hidden", 0))).alias("hidden"))
        named, new = store.upsert_payloads(db.table("pairs"), _values(db), good)
        keys = [r["key"] for r in new.orderBy("seq").collect()]  # at most BATCH_MOST rows
        named, both = cut(named), cut(_values(db).unionByName(new.select("key", "payload")))
        db.replace("values", both)
        db.replace("pairs", named)
    return {"applied": len(keys), "failed": len(items) - len(keys), "keys": keys}


def _scan_options(a: dict) -> dict:
    return {"limit": _limit(a, default=int(a.get(1, 0))), "cursor": a.get("cursor"), "include_hidden": flag(a.get("include_hidden", 0))}


@command("PAIR_SCAN")
def _pair_scan(db: Database, a: dict) -> DataFrame:
    return scan.scan(db.table("pairs"), a.get("prefix", a.get(0, "*")), **_scan_options(a))


@command("PAIR_SUMMARY")
def _pair_summary(db: Database, a: dict) -> dict:
    sizes = _values(db).select("key", F.octet_length("payload").cast("long").alias("bytes"))
    prefix = a.get("prefix", a.get(0, "*"))
    hidden = flag(a.get("include_hidden", 0))
    tops = scan.branches(db.table("pairs"), prefix, depth=int(a.get("depth", 1)), limit=int(a.get("branch_limit", scan.BRANCHES)), include_hidden=hidden)
    return {**scan.summary(db.table("pairs"), sizes, prefix, include_hidden=hidden).first().asDict(), "branches": {r["branch"]: r["names"] for r in tops.collect()}}


@command("PAIR_REDUCE")
def _pair_reduce(db: Database, a: dict) -> DataFrame:
    mode = a.get("mode", a.get(0, "counts")).lower()
    edges = db.table("edges")
    page = graph.adjacency(edges, "both")
    if mode in ("degree", "graph_degree"):
        return graph.reduce_degree(page)
    if mode in ("triangle", "triangles"):
        return graph.reduce_triangles(graph.adjacency(edges, "out"), edges)
    if mode in ("pagerank_seed", "pagerank"):
        return graph.reduce_pagerank_seed(page, edges, limit=scan.page_size(_limit(a)))
    return scan.reduce(mode, db.table("pairs"), _values(db), a.get("prefix", a.get(1, "*")), limit=_limit(a), cursor=a.get("cursor"), include_hidden=flag(a.get("include_hidden", 0)))


@command("DEL")
def _del(db: Database, a: dict) -> dict:
    what = a.get(0, "values")
    if what == "values":
        key = int(a.get("key", a.get(1)))
        if not store.read(_values(db), db.rows("key long", (key,))).first()["found"]:
            raise ValueError("already_deleted")
        db.replace("values", store.delete(_values(db), db.rows("key long", (key,))))
    elif what == "pairs":
        prefix = a.get("prefix")
        if prefix is None and "key" not in a and a.get(1) is not None:
            a = {**a, "key": a[1]}
        if prefix is not None:
            pairs, values = store.purge(db.table("pairs"), _values(db), prefix, payloads=flag(a.get("payloads", 0)))
            if flag(a.get("payloads", 0)):
                db.replace("values", values)
            db.replace("pairs", pairs)
        else:
            db.replace("pairs", store.unbind(db.table("pairs"), db.rows("name string", (a["key"],))))
    elif what == "graph":
        if "node" in a or "id" in a:
            nodes, edges = graph.delete_nodes(db.table("nodes"), db.table("edges"), db.rows("id string", (a.get("node", a.get("id")),)), cascade=flag(a.get("cascade", 0)))
            if flag(a.get("cascade", 0)):
                db.replace("edges", edges)
            db.replace("nodes", nodes)
        else:
            gone = db.rows("src string, dst string, type string, directed boolean", (a["from"], a["to"], a.get("type", ""), flag(a.get("directed", 1))))
            db.replace("edges", graph.delete_edges(db.table("edges"), gone))
    elif what == "records":
        schema, rows = _record_table(db, a["table"])
        if flag(a.get("drop", 0)):
            db.folder.drop(f"records-{a['table']}")
            db.folder.drop(f"records-{a['table']}.current")
            db.folder.drop(f"{a['table']}.schema")
        else:
            db.folder.replace(f"records-{schema.table}", records.delete(rows, db.rows("key string", (a["key"],))))
    elif what == "graph_cache":
        for name in ("links", "answers"):
            db.replace(name, db.table(name).where(F.lit(False)))
    else:
        raise ValueError(f"unknown_namespace:{what}")
    return {"deleted": what}


# Records.


def _record_table(db: Database, name: str) -> tuple[records.Schema, DataFrame]:
    text = db.folder.load(f"{name}.schema")
    if text is None:
        raise ValueError("table_not_found")
    schema = records.Schema.from_json(text)
    return schema, db.folder.table(f"records-{name}", schema.struct())


def _typed(schema: records.Schema, db: Database, a: dict) -> DataFrame:
    given = {k: v for k, v in a.items() if isinstance(k, str) and k not in ("table", "key")}
    for k in given:
        schema[k]
    raw = db.rows("key string, seq int" + "".join(f", `{k}` string" for k in given), (a["key"], 0, *given.values()))
    out = raw.select("key", "seq", *[schema[k].parsed(F.col(k)).alias(k) for k in given])
    row = out.first()
    for k in given:
        if row[k] is None:
            raise ValueError(f"value_out_of_range:{k}")
    return out


@command("RECORD")
def _record(db: Database, a: dict) -> Answer:
    verb, name = a.get(0), a.get("table")
    fields = a["fields"].split(",") if a.get("fields") else None
    if verb == "define":
        if db.folder.load(f"{name}.schema") is not None:
            if flag(a.get("if_not_exists", 0)):
                return {"table": name}
            raise ValueError("table_exists")
        db.folder.save(f"{name}.schema", records.define(name, a["fields"]).to_json())
        return {"table": name}
    if verb == "tables":
        return {"tables": [n.removeprefix("records-") for n in db.folder.listed() if n.startswith("records-")]}
    schema, rows = _record_table(db, name)
    if verb == "schema":
        return {**json.loads(schema.to_json()), **({"rows": rows.count()} if flag(a.get("rows", 0)) else {})}
    if verb in ("alter", "compact"):
        if verb == "alter":
            schema, rows = records.alter(schema, rows, add=a.get("add", ""), drop=a.get("drop", ""))
        if verb == "compact" or flag(a.get("compact", 0)):
            schema = records.compact(schema)
        db.folder.replace(f"records-{name}", rows)
        db.folder.save(f"{name}.schema", schema.to_json())
        return json.loads(schema.to_json())
    if verb == "index":
        if a.get("action") == "list":
            return {"indexed": [f.name for f in schema.fields if f.indexed]}
        db.folder.save(f"{name}.schema", records.index(schema, a["field"], a.get("action", "create")).to_json())
        return {"field": a["field"]}
    if verb == "set":
        db.folder.replace(f"records-{name}", records.write(schema, rows, _typed(schema, db, {k: v for k, v in a.items() if k != 0})))
        return {"key": a["key"]}
    if verb == "get":
        return records.get(schema, rows, a["key"], fields)
    if verb == "scan":
        return records.scan(schema, rows, prefix=a.get("prefix", "*"), limit=_limit(a), cursor=a.get("cursor"), fields=fields)
    if verb in ("select", "reduce", "where"):
        value = _typed(schema, db, {"key": "", a["field"]: a["value"]}).first()[a["field"]]
        return records.select(schema, rows, a["field"], a.get("op", "eq"), value, prefix=a.get("prefix", "*"), limit=_limit(a), budget=int(a.get("budget", records.BUDGET)), fields=fields)
    raise ValueError(f"unknown_verb:{verb}")


# The graph.


@command("GRAPH_NODE_SET")
def _node_set(db: Database, a: dict) -> dict:
    schema = "id string, seq int, at timestamp, labels array<string>, props string"
    labels = a["labels"].split(",") if "labels" in a else None
    old = db.table("nodes").select("id", F.lit(0).alias("seq"), F.col("created_at").alias("at"), "labels", "props")
    new = db.rows(schema, (a["id"].strip(), 1, None, labels, a.get("props"))).withColumn("at", F.current_timestamp())
    db.replace("nodes", graph.upsert_nodes(old.unionByName(new)))
    if "references" in a:
        kept = db.table("sentences").where(F.col("node") != a["id"])
        if a["references"] != "-":
            refs = json.loads(a["references"])
            said = db.rows("node string, ref string, text string, source string, ordinal int", *[(a["id"], r.get("id"), r.get("text"), r.get("source"), int(r.get("ordinal", i))) for i, r in enumerate(refs)])
            kept = kept.unionByName(graph.reference_sentences(said).select(kept.columns))
        db.replace("sentences", kept)
    return {"id": a["id"]}


def _edge_writes(db: Database, items: list[dict]) -> dict:
    number = lambda x: None if x in (None, "") else float(x)
    schema = "seq int, src string, dst string, type string, directed boolean, weight double, confidence double, modality string, ambiguity string, props string"
    rows = [
        (i + 1, x["from"], x["to"], x.get("type", ""), flag(x.get("directed", 1)), number(x.get("weight")), number(x.get("confidence")), x.get("modality"), x.get("ambiguity", x.get("oneof")), x.get("props") if isinstance(x.get("props"), str | None) else json.dumps(x["props"]))
        for i, x in enumerate(items)
    ]
    writes = db.rows(schema, *rows)
    missing = graph.stubs(db.table("nodes"), writes)
    if not all(flag(x.get("autocreate", 1)) for x in items) and not missing.isEmpty():
        raise ValueError("from_node_not_found")
    old = db.table("edges").drop("id").withColumn("seq", F.lit(0))
    with db.lock:
        db.replace("nodes", db.table("nodes").unionByName(missing.select("id", F.array().cast("array<string>").alias("labels"), F.lit("{}").alias("props"), F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at"))))
        db.replace("edges", graph.upsert_edges(old.unionByName(writes)))
    return {"applied": len(items)}


COMMANDS["GRAPH_EDGE_SET"] = lambda db, a: _edge_writes(db, [a])


@command("GRAPH_EDGE_SET_BATCH")
def _edge_batch(db: Database, a: dict) -> dict:
    shared = {k: v for k, v in a.items() if isinstance(k, str) and k != "items"}
    return _edge_writes(db, [{**shared, **x} for x in (json.loads(a["items"]) if isinstance(a["items"], str) else a["items"])])


COMMANDS["GRAPH_NODE_GET"] = lambda db, a: db.table("nodes").where(F.col("id") == a.get("id", a.get(0)))


@command("GRAPH_EDGE_GET")
def _edge_get(db: Database, a: dict) -> DataFrame:
    return db.table("edges").where((F.col("src") == a["from"]) & (F.col("dst") == a["to"]) & (F.col("type") == a.get("type", "")) & (F.col("directed") == flag(a.get("directed", 1))))


@command("GRAPH_NEIGHBORS")
def _neighbors(db: Database, a: dict) -> DataFrame:
    return graph.neighbors(db.table("edges"), a["id"], direction=a.get("direction", "out"), type=a.get("type", "*"), limit=_limit(a))


@command("GRAPH_DEGREE")
def _degree(db: Database, a: dict) -> DataFrame:
    return graph.degree(db.table("edges"), direction=a.get("direction", "out"), type=a.get("type", "*"), weighted=flag(a.get("weighted", 0))).where(F.col("node") == a["id"])


@command("GRAPH_NEIGHBOR_TYPES")
def _neighbor_types(db: Database, a: dict) -> DataFrame:
    rows = graph.neighbor_types(db.table("edges"), direction=a.get("direction", "out"), limit=_limit(a)).where(F.col("node") == a["id"])
    return rows.groupBy("type").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).orderBy(F.desc("n"), F.desc("weight"), "type")


COMMANDS["GRAPH_QUERY"] = lambda db, a: pattern.query(db.table("edges"), db.table("nodes"), a["query"])


def _options(a: dict, **more: object) -> recall.Options:
    kinds = {"precision": float, "hops": int, "decay": float, "min_sources": int, "branch": int, "budget": int, "seed_limit": int, "limit": int, "direction": str}
    return recall.Options(**{k: kinds[k](v) for k, v in a.items() if k in kinds}, include_seeds=flag(a.get("include_seeds", 0)), types=tuple(a["types"].split(",")) if a.get("types") else (), **more)


@command("GRAPH_RECALL")
def _recall(db: Database, a: dict) -> DataFrame:
    seeds = list(dict.fromkeys(s.strip() for s in a["seeds"].split(",") if s.strip()))
    asked = db.rows("query string, seed string", *[("q", s) for s in seeds])
    factors = {r["relation"]: r["factor"] for r in recall.relation_factors(db.table("pred").where(F.col("table") == "graph_recall_decay").drop("table")).collect()}  # a row a relation type
    found = recall.recall(asked, db.table("nodes"), db.table("edges"), _options(a, relation_factors=factors or None), shortcuts=db.table("links") if a.get("cache", "on") != "off" else None)
    if flag(a.get("references", 0)):
        found = recall.evidence(found, db.table("nodes"), db.table("sentences"))
    return found.drop("query").orderBy("rank")


@command("GRAPH_SIMILAR")
def _similar(db: Database, a: dict) -> DataFrame:
    asked = db.rows("id string", (a["id"],))
    return recall.similar(asked, db.table("nodes"), db.table("edges"), by=a.get("by", "all"), limit=_limit(a, default=32), precision=float(a.get("precision", 0.05))).orderBy(F.desc("score"), "candidate")


@command("GRAPH_TERM_INDEX")
def _term_index(db: Database, a: dict) -> DataFrame:
    return terms.stats(db.table("nodes"), terms.node_tokens(db.table("nodes"), db.table("sentences")))


@command("GRAPH_AMBIGUITY_SET")
def _ambiguity_set(db: Database, a: dict) -> dict:
    options = [o.partition("=") for o in (a["options"].split(",") if isinstance(a["options"], str) else a["options"])]
    if len(options) < 2:
        raise ValueError("ambiguity_requires_two_options")
    rows = db.rows("dst string, share double", *[(o.strip(), float(s) if eq else None) for o, eq, s in options])
    shared = graph.distribute(rows.withColumn("g", F.lit(1)), group=["g"], normalize=flag(a.get("normalize", 1))).collect()
    if any(not 0 <= r["confidence"] <= 1 for r in shared):
        raise ValueError("share_above_one_without_normalize")
    return _edge_writes(db, [{"from": a["from"], "to": r["dst"], "type": a.get("type", ""), "confidence": r["confidence"], "ambiguity": a["group"]} for r in shared])


@command("GRAPH_AMBIGUITY_GET")
def _ambiguity_get(db: Database, a: dict) -> DataFrame:
    rows = db.table("edges").where((F.col("src") == a["from"]) & (F.col("ambiguity") == a["group"]))
    return rows.orderBy(F.desc(F.coalesce("confidence", F.lit(1.0))), "dst")


@command("GRAPH_AMBIGUITY_RESOLVE")
def _ambiguity_resolve(db: Database, a: dict) -> dict:
    winners = db.rows("src string, ambiguity string, winner string", (a["from"], a["group"], a["winner"]))
    db.replace("edges", graph.resolve_ambiguity(db.table("edges"), winners, drop=flag(a.get("drop", 0))))
    return {"winner": a["winner"]}


@command("GRAPH_CACHE")
def _graph_cache(db: Database, a: dict) -> Answer:
    verb, now = a.get(0, "stats"), time.time()
    if verb == "stats":
        return memo.stats(db.table("links"), db.table("answers"), now)
    if verb == "config":
        return {"sample": memo.SAMPLE, "capacity": memo.CAPACITY, "half_life": memo.HALF_LIFE, "min_utility": memo.LEAST_UTILITY}
    if verb == "links":
        return db.table("links").where(F.col("src") == a["id"])
    if verb == "get":
        return db.table("links").where((F.col("src") == a["from"]) & (F.col("dst") == a["to"]))
    if verb == "common":
        return memo.serve(db.table("answers"), db.rows("signature string", (a["signature"],)), db.epoch)
    if verb == "put":
        seen = db.rows("src string, dst string, score double, distance long, sources long", (a["from"], a["to"], float(a.get("score", 1)), int(a.get("distance", 2)), 1))
        db.replace("links", memo.observe_links(db.table("links"), seen, now, sample=float(a.get("sample", memo.SAMPLE))))
        return {"links": db.table("links").count()}
    if verb == "prune":
        for name in ("links", "answers"):
            db.replace(name, memo.prune(db.table(name), now, age=flag(a.get("age", 0))))
        return {"links": db.table("links").count()}
    raise ValueError(f"unknown_verb:{verb}")


# Prediction.


def _pred(db: Database, a: dict) -> DataFrame:
    return db.table("pred").where(F.col("table") == a.get("table", "default")).drop("table")


def _save_pred(db: Database, a: dict, rows: DataFrame) -> None:
    name = a.get("table", "default")
    others = db.table("pred").where(F.col("table") != name)
    db.replace("pred", others.unionByName(rows.withColumn("table", F.lit(name)).select(others.columns)))


@command("PREDICT_SET")
def _predict_set(db: Database, a: dict) -> dict:
    weights = json.loads(a["weights"]) if a.get("weights") else None
    log = db.rows(f"key string, value string, score double, weights {predict.WEIGHTS}, seq int", (a["key"], a["value"], float(a.get("prob", 0.5)), weights, 0))
    _save_pred(db, a, predict.upsert(_pred(db, a), log))
    return {"key": a["key"]}


@command("PREDICT_QUERY")
def _predict_query(db: Database, a: dict) -> DataFrame:
    keys = a["keys"].split(",") if a.get("keys") else [a["key"]]
    context = json.loads(a["ctx"]) if a.get("ctx") else None
    found = predict.softmax(_pred(db, a).where(F.col("key").isin(*keys)), context=context)
    if a.get("keys"):
        found = predict.merged(found, a.get("merge", "avg"))
    return found.orderBy(F.desc("probability"), "value")


@command("PREDICT_TRAIN")
def _predict_train(db: Database, a: dict) -> dict:
    step = (a["key"], 0, a["target"], a["negatives"].split(",") if a.get("negatives") else [], float(a.get("lr", 0.01)), json.loads(a["ctx"]) if a.get("ctx") else None)
    steps = db.rows("key string, seq int, target string, negatives array<string>, rate double, context array<array<double>>", step)
    if _pred(db, a).where(F.col("key") == a["key"]).isEmpty():
        raise ValueError("prediction_entry_not_found")
    _save_pred(db, a, predict.train(_pred(db, a), steps))
    return {"key": a["key"]}


@command("PREDICT_CTX")
def _predict_ctx(db: Database, a: dict) -> dict:
    rows = _pred(db, a)
    own = F.col("key") == a["key"]
    moved = predict.adjust(rows.where(own), json.loads(a["ctx"]), mode=a.get("mode", "bias"), strength=float(a.get("strength", 1)))
    _save_pred(db, a, rows.where(~own).unionByName(moved))
    return {"key": a["key"]}


def _inherit(db: Database, a: dict, items: list[dict]) -> dict:
    wanted = db.rows("key string, target string, source string", *[(x.get("key", a.get("key")), x["target"], s) for x in items for s in (x["sources"].split(",") if isinstance(x["sources"], str) else x["sources"])])
    made = predict.inherit(_pred(db, a), wanted, a.get("merge", "avg"))
    done = made.select("key", "value").collect()  # at most BATCH_MOST rows
    if not done:
        raise ValueError("inherit_sources_missing")
    _save_pred(db, a, predict.with_inherited(_pred(db, a), made))
    return {"made": len(done)}


COMMANDS["PREDICT_INHERIT"] = lambda db, a: _inherit(db, a, [a])


@command("PREDICT_INHERIT_BATCH")
def _inherit_batch(db: Database, a: dict) -> dict:
    items = json.loads(a["items"]) if isinstance(a["items"], str) else a["items"]
    if len(items) > BATCH_MOST:
        raise ValueError("too_many_items")
    return _inherit(db, a, items)


COMMANDS["PREDICT_BACKEND"] = lambda db, a: {"backend": "spark"}


@command("PREDICT_BENCH")
def _predict_bench(db: Database, a: dict) -> dict:
    began = time.time()
    n = db.spark.range(int(a.get("rows", 1000))).select(F.array(*[F.rand(i) for i in range(8)]).alias("vector"), F.lit(0).alias("g"))
    predict.window_mean(n, ["g"]).collect()
    return {"seconds": time.time() - began}


# Placement, system, batches, jobs.


@command("CLUSTER_UPDATE")
def _cluster_update(db: Database, a: dict) -> dict:
    nodes = json.loads(a["nodes"]) if isinstance(a["nodes"], str) else a["nodes"]
    db.engine.topology.update([placement.Member(n["id"], n.get("address", ""), int(n.get("capacity", 1))) for n in nodes], int(a.get("replication", 1)))
    return {"nodes": len(nodes)}


COMMANDS["CLUSTER_STATUS"] = lambda db, a: db.engine.topology.status(db.spark)


@command("CLUSTER_MOVE")
def _cluster_move(db: Database, a: dict) -> dict:
    fork = a.get("fork") or placement.fork_id(a["prefix"])
    db.engine.topology.move(fork, a.get("node", ""))
    if a.get("path") and a.get("prefix"):
        export_fork(db.table("pairs"), _values(db), db.table("pred"), a["prefix"], a["path"])
    return {"fork": fork}


@command("CLUSTER_GOSSIP")
def _cluster_gossip(db: Database, a: dict) -> dict:
    told = json.loads(a["topology"])
    db.engine.topology.gossip(placement.Topology([placement.Member(**m) for m in told.get("members", [])], overrides=told.get("overrides", {})))
    return {"nodes": len(db.engine.topology.members)}


@command("FORK_ASSIGN")
def _fork_assign(db: Database, a: dict) -> dict:
    fork, nodes = db.engine.topology.assign(a.get("prefix", a.get(0, "")))
    return {"fork": fork, "nodes": nodes}


@command("SYSTEM_STATS")
def _system_stats(db: Database, a: dict) -> dict:
    sc = db.spark.sparkContext
    return {"uptime": time.time() - db.engine.started, "parallelism": sc.defaultParallelism, "jobs": len(db.jobs), "active": len(sc.statusTracker().getActiveJobsIds()), "databases": len(db.engine.open)}


@command("LOG_FLUSH")
def _log_flush(db: Database, a: dict) -> dict:
    out, db.engine.lines[:] = list(db.engine.lines), []
    return {"lines": out}


COMMANDS["FILE_CHECKPOINT"] = lambda db, a: {"flushed": True}  # every write is a whole snapshot
COMMANDS["DB_CREATE"] = lambda db, a: {"name": db.engine.create(a.get("name", a.get(0)), **{k: v for k, v in a.items() if isinstance(k, str) and k != "name"}).name}
COMMANDS["DB_CONFIG"] = lambda db, a: db.engine.configure(a.get("name", a.get(0, db.name)), **{k: v for k, v in a.items() if isinstance(k, str) and k != "name"})
COMMANDS["DB_LIST"] = lambda db, a: {"databases": db.engine.list()}
COMMANDS["DATABASE"] = lambda db, a: {"name": db.engine.database(a.get("name", a.get(0))).name}
COMMANDS["RESET_DB"] = lambda db, a: db.engine.reset(a.get("name", a.get(0, db.name))) or {"reset": True}
COMMANDS["EXIT"] = lambda db, a: {"bye": True}


@command("ALIAS")
def _alias(db: Database, a: dict) -> dict:
    return {"commands": sorted(COMMANDS), "aliases": dict(sorted(ALIASES.items()))}


def _whole(answer: DataFrame) -> list[dict]:
    """All rows of an answer, which must be no more than a page: an item that wants more is to be asked by itself, by cursor."""
    rows = answer.limit(scan.PAGE_MOST + 1).collect()
    if len(rows) > scan.PAGE_MOST:
        raise ValueError("answer_too_large")
    return [r.asDict(recursive=True) for r in rows]


@command("BATCH")
def _batch(db: Database, a: dict) -> dict:
    """A command for each item in order; stops at the first failure unless told to go on.  Edges are written as one."""
    target = str(a.get("command", a.get("target", a.get(0)))).upper()
    items = json.loads(a["items"]) if isinstance(a["items"], str) else a["items"]
    if target in UNBATCHED or target not in COMMANDS and target not in ALIASES:
        raise ValueError("batch_target_not_allowed")
    if len(items) > BATCH_MOST:
        raise ValueError("too_many_items")
    spelt = ALIASES.get(target, target)  # "COMMAND" or "COMMAND word…"
    shared = {k: v for k, v in a.items() if isinstance(k, str) and k not in ("items", "command", "target", "continue_on_error", "results", "async")}
    goes_on = flag(a.get("continue_on_error", 0))
    if target == "GRAPH_EDGE_SET" and all(isinstance(x, dict) and x.get("from", shared.get("from")) and x.get("to", shared.get("to")) for x in items):
        return {**_edge_writes(db, [{**shared, **x} for x in items]), "failed": 0, "first_error": ""}
    out = {"applied": 0, "failed": 0, "first_error": "", "results": [None] * len(items)}
    for i, x in enumerate(items):
        try:
            if isinstance(x, dict):
                name, fixed = parse(spelt)
                answer = COMMANDS[name](db, {**fixed, **shared, **x})
            else:
                answer = db.execute(f"{target} " + (" ".join(map(str, x)) if isinstance(x, list) else str(x)))
            out["results"][i] = answer if isinstance(answer, dict) else _whole(answer)
            out["applied"] += 1
        except (ValueError, KeyError) as e:
            out["failed"] += 1
            out["first_error"] = out["first_error"] or f"item_{i}:{e}"
            out["results"][i] = f"ERROR,{e}"
            if not goes_on:
                break
    if not flag(a.get("results", 0)):
        del out["results"]
    return out


@command("JOB")
def _job(db: Database, a: dict) -> dict:
    verb = a.get(0)
    if verb == "submit":
        rest = " ".join([*(str(v) for k, v in a.items() if isinstance(k, int) and k > 0), *(shlex.quote(f"{k}={v}") for k, v in a.items() if isinstance(k, str))])
        job = db.submit(rest)
        return {"job": job.id, "state": job.state}
    job = db.jobs.get(a.get("job", a.get("id", a.get(1))))
    if job is None:
        raise ValueError("job_not_found")
    if verb == "status":
        return {"job": job.id, "state": job.state, "command": job.command}
    if verb == "results":
        rows = job.future.result().get("rows", []) if job.state == "done" else []
        at, n = int(a.get("from", 0)), min(int(a.get("limit", PAGE)) or PAGE, PAGE)
        return {"job": job.id, "rows": rows[at : at + n], "next": at + len(rows[at : at + n]), "available": len(rows)}
    if verb == "fetch":
        if job.state == "running":
            raise ValueError("job_not_ready")
        del db.jobs[job.id]
        return job.future.result()
    raise ValueError(f"unknown_verb:{verb}")
