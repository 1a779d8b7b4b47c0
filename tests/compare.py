"""Comparison of a Spark result with that of SQL: the same columns, and the same rows in any order."""

from __future__ import annotations

import decimal

import numpy as np


def norm(v):
    if isinstance(v, np.generic):
        v = v.item()
    if v is None or isinstance(v, bool | int | str):
        return v
    if isinstance(v, decimal.Decimal):
        return int(v) if v == int(v) else round(float(v), 6)
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    if isinstance(v, bytes | bytearray):
        return bytes(v).hex()
    if isinstance(v, dict):
        return [norm(x) for x in v.values()]
    if isinstance(v, list | tuple | np.ndarray):
        return [norm(x) for x in v]
    return str(v)


def rows(records, columns) -> list[str]:
    return sorted(repr([norm(r[c]) for c in columns]) for r in records)


def same(df, con, sql: str) -> None:
    columns = sorted(df.columns)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert rows(df.collect(), columns) == rows([dict(zip(names, r)) for r in found.fetchall()], columns)
