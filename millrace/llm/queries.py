"""The registered queries of this subpackage: thin calls with production parameters over whole tables."""

from __future__ import annotations

from .brown import score_documents
from .html import extract_pages
from .longmatches import long_match_dedup
from .media import media_columns
from .minhash import near_duplicates
from .mixing import mix_sources
from .oracle import ORACLE_SQL
from .packing import pack_documents
from .quality import quality_rules, train
from .secrets import secret_spans
from .shared import documents
from .substrings import substring_dedup

__all__ = ["ORACLE_SQL", "QUERIES"]


def _quality(spark, sf):
    docs = documents(spark, sf)
    return quality_rules(docs, train(docs, spark.read.parquet(f"{sf}/labels.parquet")))


QUERIES = {
    "op1_quality_rules": _quality,
    "op2_minhash_dedup": lambda spark, sf: near_duplicates(documents(spark, sf)),
    "op3_secret_scans": lambda spark, sf: secret_spans(documents(spark, sf)),
    "op4_substring_dedup": lambda spark, sf: substring_dedup(documents(spark, sf)),
    "op5_run_length_index": lambda spark, sf: long_match_dedup(documents(spark, sf)),
    "op6_mixing": lambda spark, sf: mix_sources(documents(spark, sf)),
    "op7_html_extraction": lambda spark, sf: extract_pages(spark.read.parquet(f"{sf}/pages.parquet")),
    "op8_brown_scores": lambda spark, sf: score_documents(documents(spark, sf)),
    "op9_packing": lambda spark, sf: pack_documents(documents(spark, sf)),
    "op10_media": lambda spark, sf: media_columns(documents(spark, sf)),
}
