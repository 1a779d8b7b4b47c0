"""Record tables: typed rows under a byte key, with a schema that evolves without rewriting.

A table is its schema and a DataFrame with the columns ``key`` and one per field.  A field that was added after a row
was last written is null in it; the next partial write fills it with zero.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.literals import truthy, under

NAME = re.compile(r"[a-z][a-z0-9_]{0,47}")
RESERVED = frozenset("table key keys fields field op value prefix limit cursor budget add drop compact rows action if_not_exists".split())
MOST_FIELDS, MOST_WIDTH = 512, 1 << 20
SELECT_LIMIT, SELECT_MOST = 500, 10_000
BUDGET, BUDGET_MOST = 4096, 262_144
OPS = ("eq", "ne", "lt", "lte", "gt", "gte")


@dataclass(frozen=True)
class Field:
    name: str
    kind: str  # uint, int, float, bool, bytes, string
    width: int
    offset: int = 0
    indexed: bool = False

    @property
    def type(self) -> T.DataType:
        if self.kind == "uint":
            return {1: T.ShortType(), 2: T.IntegerType(), 8: T.DecimalType(20, 0)}.get(self.width, T.LongType())
        if self.kind == "int":
            return {1: T.ByteType(), 2: T.ShortType(), 3: T.IntegerType(), 4: T.IntegerType()}.get(self.width, T.LongType())
        return {"float": T.FloatType() if self.width == 4 else T.DoubleType(), "bool": T.BooleanType(), "bytes": T.BinaryType(), "string": T.StringType()}[self.kind]

    def limits(self) -> tuple[int, int] | None:
        bits = 8 * self.width
        return {"uint": (0, 2**bits - 1), "int": (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1)}.get(self.kind)

    def zero(self) -> Column:
        if self.kind == "bytes":
            return F.lit(bytes(self.width))
        return F.lit({"bool": False, "string": "", "float": 0.0}.get(self.kind, 0)).cast(self.type)

    def parsed(self, raw: Column) -> Column:
        """The text of a value as the field's; null where it is out of range or too long."""
        if self.kind in ("uint", "int"):
            number = raw.try_cast("decimal(38,0)")
            low, high = self.limits()
            return F.when((number >= low) & (number <= high), number.cast(self.type))
        if self.kind == "float":
            return raw.try_cast(self.type)
        if self.kind == "bool":
            return F.when(raw.isNotNull(), truthy(raw))
        if self.kind == "bytes":
            return F.when(F.octet_length(raw.cast("binary")) <= self.width, padded(raw.cast("binary"), self.width))
        return F.when(F.octet_length(raw) <= self.width, F.regexp_replace(raw, "\x00+$", ""))

    def shown(self, column: Column) -> Column:
        """What a read returns: floats as doubles, bytes as x and hex."""
        if self.kind == "float":
            return column.cast("double")
        return F.concat(F.lit("x"), F.lower(F.hex(column))) if self.kind == "bytes" else column


def padded(raw: Column, width: int) -> Column:
    return F.unhex(F.rpad(F.hex(raw), 2 * width, "0"))


@dataclass(frozen=True)
class Schema:
    table: str
    fields: tuple[Field, ...]
    width: int
    dead: int = 0
    generation: int = 1

    def __getitem__(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise KeyError(f"unknown_field:{name}")

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField("key", T.StringType(), False), *[T.StructField(f.name, f.type) for f in self.fields]])

    def to_json(self) -> str:
        return json.dumps({"table": self.table, "width": self.width, "dead": self.dead, "generation": self.generation, "fields": [vars(f) for f in self.fields]})

    @staticmethod
    def from_json(text: str) -> Schema:
        d = json.loads(text)
        return Schema(d["table"], tuple(Field(**f) for f in d["fields"]), d["width"], d["dead"], d["generation"])


def _field(spec: str, offset: int) -> Field:
    name, kind, *rest = spec.strip().split(":")
    if not NAME.fullmatch(name) or name in RESERVED:
        raise ValueError(f"invalid_field_name:{name}")
    if kind in ("uint", "int"):
        width = int(rest[0]) if rest else 8
        good = 1 <= width <= 8
    elif kind == "float":
        width = int(rest[0]) if rest else 8
        good = width in (4, 8)
    elif kind == "bool":
        width, good = 1, not rest or rest == ["1"]
    elif kind in ("bytes", "string"):
        width = int(rest[0]) if rest else 0
        good = 1 <= width <= 4096
    else:
        raise ValueError(f"unknown_field_type:{kind}")
    if not good:
        raise ValueError(f"invalid_field_width:{name}")
    return Field(name, kind, width, offset)


def define(table: str, fields: str) -> Schema:
    """A schema of ``name:type[:bytes]`` items."""
    out, offset = [], 0
    for spec in fields.split(","):
        out.append(_field(spec, offset))
        offset += out[-1].width
    if len({f.name for f in out}) < len(out):
        raise ValueError("duplicate_field")
    if len(out) > MOST_FIELDS or offset > MOST_WIDTH:
        raise ValueError("row_too_wide")
    return Schema(table, tuple(out), offset)


def alter(schema: Schema, rows: DataFrame, *, add: str = "", drop: str = "") -> tuple[Schema, DataFrame]:
    """Drops, then adds, fields.  No row is rewritten: a dropped field leaves dead bytes, an added one is null in all rows, one dropped and added again too."""
    gone = [n.strip() for n in drop.split(",") if n.strip()]
    for n in gone:
        schema[n]
    fields = [f for f in schema.fields if f.name not in gone]
    dead = schema.dead + sum(schema[n].width for n in gone)
    rows, width = rows.drop(*gone), schema.width
    for spec in (s for s in add.split(",") if s.strip()):
        f = _field(spec, width)
        if any(f.name == g.name for g in fields):
            raise ValueError(f"field_exists:{f.name}")
        fields.append(f)
        width += f.width
        rows = rows.withColumn(f.name, F.lit(None).cast(f.type))
    if not fields:
        raise ValueError("last_field")
    return replace(schema, fields=tuple(fields), width=width, dead=dead), rows


def compact(schema: Schema) -> Schema:
    """Offsets without dead bytes, in the next generation; rows as columns have nothing to move."""
    out, offset = [], 0
    for f in schema.fields:
        out.append(replace(f, offset=offset))
        offset += f.width
    return replace(schema, fields=tuple(out), width=offset, dead=0, generation=schema.generation + 1)


def index(schema: Schema, field: str, action: str = "create") -> Schema:
    """Marks a field as indexed (create, rebuild) or not (drop): selects on it are then in order of value."""
    schema[field]
    on = {"create": True, "rebuild": True, "drop": False}[action]
    return replace(schema, fields=tuple(replace(f, indexed=on) if f.name == field else f for f in schema.fields))


def clustered(schema: Schema, rows: DataFrame, field: str) -> DataFrame:
    """Rows laid out so that a scan with a predicate on the field skips most row groups; written sorted, this is the index."""
    return rows.repartitionByRange(F.col(schema[field].name)).sortWithinPartitions(field)


def write(schema: Schema, rows: DataFrame, writes: DataFrame) -> DataFrame:
    """Rows after partial writes (key, seq, and any of the fields, null where not set).

    Each field has its last value set; what was never set is zero in every row that is written, also where it was null for
    being younger than the row.  Rows that aren't written stay as they are.
    """
    set_ = [f for f in schema.fields if f.name in writes.columns]
    last = writes.groupBy("key").agg(F.lit(True).alias("__w"), *[F.max_by(f.name, F.when(F.col(f.name).isNotNull(), F.col("seq"))).alias(f"__{f.name}") for f in set_])
    joined = rows.join(last, "key", "full_outer")
    out = []
    for f in schema.fields:
        old = F.col(f.name)
        new = F.coalesce(F.col(f"__{f.name}").cast(f.type), old, f.zero()) if f in set_ else F.coalesce(old, f.zero())
        out.append(F.when(F.col("__w"), new).otherwise(old).alias(f.name))
    return joined.select("key", *out)


def invalid(schema: Schema, writes: DataFrame) -> DataFrame:
    """Writes whose integers are out of their field's range or whose strings are too long, with the error."""
    out = None
    for f in schema.fields:
        if f.name not in writes.columns:
            continue
        c = F.col(f.name)
        low_high = f.limits()
        bad = ((c < low_high[0]) | (c > low_high[1])) if low_high else (F.octet_length(c) > f.width) if f.kind in ("string", "bytes") else F.lit(False)
        one = F.when(bad, F.lit(f"value_out_of_range:{f.name}"))
        out = one if out is None else F.coalesce(out, one)
    return writes.withColumn("error", out).where(F.col("error").isNotNull())


def get(schema: Schema, rows: DataFrame, key: str, fields: list[str] | None = None) -> DataFrame:
    return project(schema, rows.where(F.col("key") == key), fields)


def project(schema: Schema, rows: DataFrame, fields: list[str] | None = None) -> DataFrame:
    chosen = [schema[n] for n in fields] if fields else list(schema.fields)
    return rows.select("key", *[f.shown(F.col(f.name)).alias(f.name) for f in chosen])


def scan(schema: Schema, rows: DataFrame, *, prefix: str = "*", limit: int = 0, cursor: str | None = None, fields: list[str] | None = None) -> DataFrame:
    """A page in order of key, after the cursor."""
    from .scan import page_size

    found = rows.where(under(F.col("key"), prefix))
    if cursor is not None:
        found = found.where(F.col("key") > F.lit(cursor))
    size = page_size(limit)
    found = found.orderBy("key")
    return project(schema, found if size is None else found.limit(size), fields)


def select(
    schema: Schema, rows: DataFrame, field: str, op: str, value: object, *, prefix: str = "*", limit: int = 0, budget: int | None = None, fields: list[str] | None = None
) -> DataFrame:
    """Rows whose field compares so with the value; null never does, not even for ne.

    In order of key, or of value and key for an indexed field.  ``budget`` bounds the rows looked at, in that order, before
    the predicate (None: all, the set-oriented default); limit 0 is 500, at most 10000.
    """
    f = schema[field]
    c, v = F.col(field), F.lit(value)
    test = {"eq": c == v, "ne": c != v, "lt": c < v, "lte": c <= v, "gt": c > v, "gte": c >= v}[op]
    found = rows.where(under(F.col("key"), prefix))
    order = [field, "key"] if f.indexed else ["key"]
    if budget is not None:
        most = min(max(budget, 1), BUDGET_MOST)
        found = (found.where(test) if f.indexed else found).orderBy(*order).limit(most)
    size = SELECT_LIMIT if limit <= 0 else min(limit, SELECT_MOST)
    return project(schema, found.where(test).orderBy(*order).limit(size), fields)


def select_all(schema: Schema, rows: DataFrame, field: str, op: str, value: object, fields: list[str] | None = None) -> DataFrame:
    """The same predicate without order or limit: the bulk form, pushed to the scan."""
    c, v = F.col(schema[field].name), F.lit(value)
    test = {"eq": c == v, "ne": c != v, "lt": c < v, "lte": c <= v, "gt": c > v, "gte": c >= v}[op]
    return project(schema, rows.where(test), fields)


def delete(rows: DataFrame, keys: DataFrame) -> DataFrame:
    return rows.join(keys.select("key").distinct(), "key", "left_anti")

