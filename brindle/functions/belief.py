"""The ordered scale of modal words and its correspondence with confidences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = (("ruled_out", 0.0), ("unlikely", 0.25), ("possible", 0.5), ("probable", 0.75), ("certain", 1.0))
WORDS = {
    "ruled_out": "ruled_out ruledout excluded impossible no false",
    "unlikely": "unlikely improbable doubtful rare",
    "possible": "possible maybe perhaps uncertain unverified",
    "probable": "probable likely presumably expected",
    "certain": "certain sure asserted definite confirmed verified yes true",
}
CANONICAL = {word: name for name, words in WORDS.items() for word in words.split()}


def _lookup(table: dict[str, object], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def canonical(word: Column) -> Column:
    """The scale's word for a synonym; null for none."""
    return _lookup(CANONICAL, F.lower(F.trim(word)))


def rank(word: Column) -> Column:
    return _lookup({name: i for i, (name, _) in enumerate(SCALE)}, canonical(word))


def confidence_of(word: Column) -> Column:
    return _lookup(dict(SCALE), canonical(word))


def modality_of(confidence: Column) -> Column:
    """The word nearest to a confidence; half-way between two it is the lower."""
    out = F.lit("certain")
    for (name, at), (_, above) in reversed(list(zip(SCALE, SCALE[1:]))):
        out = F.when(confidence <= (at + above) / 2, F.lit(name)).otherwise(out)
    return F.when(confidence.isNotNull(), out)


def parse(token: Column) -> Column:
    """Confidence of a token that is a word of the scale or a number from 0 to 1; null for anything else."""
    number = token.try_cast("double")
    return F.coalesce(confidence_of(token), F.when((number >= 0) & (number <= 1), number))


def effective_confidence(confidence: Column) -> Column:
    """An edge that declares nothing is certain."""
    return F.coalesce(confidence, F.lit(1.0))


def effective_modality(modality: Column, confidence: Column) -> Column:
    return F.coalesce(canonical(modality), modality_of(confidence), F.lit("certain"))
