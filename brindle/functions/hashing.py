"""FNV-1a, which places namespaces on the ring."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fnv64a(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


@F.arrow_udf(T.DecimalType(20, 0))
def fnv64a_column(text: pa.Array) -> pa.Array:
    """FNV-1a of each text as an unsigned 64-bit number."""
    import decimal

    found = [None if x is None else decimal.Decimal(fnv64a(x.encode())) for x in text.to_pylist()]
    return pa.array(found, pa.decimal128(20, 0))
