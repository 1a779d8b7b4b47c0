"""Registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import admin_queries, graph_queries, predict_queries, recall_queries, store_queries  # noqa: F401
from .inputs import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounded two-hop pattern query from a region back to nations, and to who is in them."""
    return QUERIES["gq_hops_1_2"](spark, sf_dir)
