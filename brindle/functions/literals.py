"""Column expressions for names, literals and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode_literal(raw: Column) -> Column:
    """Bytes of a value literal: ``x`` and at least one hex digit is hexadecimal, all else the text itself."""
    return F.when(raw.rlike("^x([0-9A-Fa-f]{2})+$"), F.unhex(F.substring(raw, 2, 1 << 30))).otherwise(raw.cast("binary"))


def b64url(text: Column) -> Column:
    """URL-safe base64 without padding; adjacency order is the order of these."""
    return F.translate(F.regexp_replace(F.base64(text.cast("binary")), "[\r\n]", ""), "+/=", "-_")


def edge_id(src: Column, kind: Column, dst: Column, directed: Column) -> Column:
    return b64url(F.concat_ws("|", directed.cast("int").cast("string"), src, kind, dst))


def normalise_token(text: Column) -> Column:
    """Lower case; runs of anything but ``a-z0-9_.:/+-`` become one underscore; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9_.:/+-]", "_"), "_+", "_"), "^_|_$", "")


def truthy(text: Column) -> Column:
    """1, true, yes and on are true; anything else is false, null too."""
    return F.coalesce(F.lower(F.trim(text)).isin("1", "true", "yes", "on"), F.lit(False))


def successor(prefix: str) -> str | None:
    """The least string greater than all that start with prefix, by code point; None if there is none."""
    for i in range(len(prefix) - 1, -1, -1):
        c = ord(prefix[i])
        if c < 0x10FFFF:
            return prefix[:i] + chr(0xE000 if 0xD7FF <= c < 0xE000 else c + 1)
    return None


def under(name: Column, prefix: str) -> Column:
    """Names that start with prefix, as a range that a Parquet scan prunes by (starts-with on bytes isn't pushed down)."""
    if prefix in ("", "*"):
        return F.lit(True)
    end = successor(prefix)
    return (name >= F.lit(prefix)) & (name < F.lit(end)) if end is not None else name >= F.lit(prefix)


def round6(x: Column) -> Column:
    """Six decimals, halves away from zero for what is not negative."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
