"""Placement of namespaces on a ring of nodes, by consistent hashing; and advice on workers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import fnv64a, fnv64a_column


@dataclass(frozen=True)
class Member:
    id: str
    address: str = ""
    capacity: int = 1


@dataclass
class Topology:
    """Nodes with their virtual places, a replication factor and forks that are placed by hand."""

    members: list[Member] = field(default_factory=list)
    replication: int = 1
    overrides: dict[str, str] = field(default_factory=dict)

    def ring(self) -> list[tuple[int, str]]:
        return sorted((fnv64a(f"{m.id}#{i}".encode()), m.id) for m in self.members for i in range(max(1, m.capacity)))

    def update(self, members: list[Member], replication: int | None = None) -> None:
        if len({m.id for m in members}) < len(members):
            raise ValueError("duplicate_node")
        self.members = list(members)
        self.replication = max(1, replication or self.replication)
        known = {m.id for m in members}
        self.overrides = {f: n for f, n in self.overrides.items() if n in known}

    def move(self, fork: str, node: str) -> None:
        """Puts a fork on a node; an empty node gives it back to the ring."""
        if not node:
            self.overrides.pop(fork, None)
        elif all(m.id != node for m in self.members):
            raise ValueError(f"unknown_node:{node}")
        else:
            self.overrides[fork] = node

    def gossip(self, other: Topology) -> None:
        """Takes over what another knows: nodes that are new here, and its placements."""
        known = {m.id for m in self.members}
        self.members += [m for m in other.members if m.id not in known]
        self.overrides = {**other.overrides, **self.overrides}

    def assign(self, prefix: str) -> tuple[str, list[str]]:
        """Fork id and nodes of a prefix: the first distinct nodes clockwise, as many as the replication factor or all there are."""
        fork = fork_id(prefix)
        if fork in self.overrides:
            return fork, [self.overrides[fork]]
        ring, h = self.ring(), fnv64a(prefix.encode())
        start = next((i for i, (at, _) in enumerate(ring) if at >= h), 0)
        clockwise = dict.fromkeys(node for _, node in ring[start:] + ring[:start])
        return fork, list(clockwise)[: max(1, self.replication)]

    def status(self, spark) -> DataFrame:
        rows = [(m.id, m.address, max(1, m.capacity)) for m in self.members]
        return spark.createDataFrame(rows, "id string, address string, capacity int")


def fork_id(prefix: str) -> str:
    return f"{fnv64a(prefix.encode() or b'\0'):016x}"


def assign_all(prefixes: DataFrame, topology: Topology) -> DataFrame:
    """prefix, fork and nodes of every row (prefix).  The ring is a literal: a few places a node."""
    ring = topology.ring()
    spark_ring = F.array(*[F.lit(str(h)).cast("decimal(20,0)") for h, _ in ring])
    starts = []
    for i in range(len(ring)):
        clockwise = dict.fromkeys(node for _, node in ring[i:] + ring[:i])
        starts.append(F.array(*[F.lit(n) for n in list(clockwise)[: max(1, topology.replication)]]))
    below = F.size(F.filter(spark_ring, lambda at: at < F.col("h")))
    start = F.when(below == len(ring), 1).otherwise(below + 1)
    rows = prefixes.select("prefix", fnv64a_column(F.col("prefix")).alias("h"), fnv64a_column(F.when(F.col("prefix") == "", F.lit("\0")).otherwise(F.col("prefix"))).alias("f"))
    wide = F.col("f").cast("decimal(38,0)")
    low = (wide % F.lit(1 << 32).cast("decimal(38,0)")).cast("long")
    high = ((wide - low.cast("decimal(38,0)")) / F.lit(1 << 32).cast("decimal(38,0)")).cast("long")
    fork = F.lower(F.concat(F.lpad(F.hex(high), 8, "0"), F.lpad(F.hex(low), 8, "0")))
    nodes = F.element_at(F.array(*starts), start) if ring else F.array().cast("array<string>")
    for name, node in sorted(topology.overrides.items()):
        nodes = F.when(F.col("fork") == name, F.array(F.lit(node))).otherwise(nodes)
    return rows.withColumn("fork", fork).select("prefix", "fork", nodes.alias("nodes"))


def advised_workers(pending: int, cores: int, process_percent: float, system_percent: float) -> int:
    """How many workers to start for pending work: fewer on a busy machine."""
    if pending <= 1:
        return max(pending, 0)
    share = 0.5 if process_percent >= 80 or system_percent >= 85 else 0.75 if process_percent >= 60 or system_percent >= 70 else 1.0
    return min(pending, max(1, int(max(1, cores) * share)))
