"""The registered query of each operator, with its production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exactdedup, htmltext, licenses, mixing, quality, setjoin, sstable, substrings, warc
from .common import table, written


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_notices(table(spark, sf_dir, "documents"))


def op3_sorted_string_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids, encoded once: sections() reads its rows twice, for the ranges and for the shards."""
    encoded = bpe.encode_packed(table(spark, sf_dir, "documents"))
    return sstable.sections(written(encoded, "encoded"), value="tokens")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 2,048 token ids; documents are encoded once, as the schedule needs their numbers before they are cut, and packed until then."""
    ids = bpe.sortable_ids()
    encoded = bpe.encode_packed(table(spark, sf_dir, "documents"), keep=("lang", "source"), ids=ids)
    return mixing.mix(written(encoded, "encoded"), content="tokens", ids=ids)


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.resolve(warc.captures(table(spark, sf_dir, "pages")))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(table(spark, sf_dir, "pages"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.jaccard_join(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.duplicates(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_license_scan": op2_license_scan,
    "op3_sorted_string_tables": op3_sorted_string_tables,
    "op4_source_mixing": op4_source_mixing,
    "op5_warc_revisits": op5_warc_revisits,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_html_extraction": op7_html_extraction,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_byte_bpe": op10_byte_bpe,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op5_warc_revisits": warc.oracle(),
    "op8_ngram_jaccard_join": setjoin.oracle(),
    "op9_exact_dedup": """
        select doc_id, kept_id, copies
        from (select doc_id, min(kept) as kept_id, count(*) as copies
              from (select doc_id, text, min(doc_id) over (partition by text) as kept from documents where text is not null) as d
              group by doc_id, text) as g
        where doc_id <> kept_id or copies > 1""",
}
