"""The registered queries outside the training-data subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import body_queries, delivery_queries, document_queries, extraction_queries, form_queries, front_queries, grid_queries, layout_queries, operation_queries, record_queries, rule_queries, scalar_queries, span_queries, stream_queries, structure_queries, validation_queries, zone_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (body_queries, delivery_queries, document_queries, extraction_queries, form_queries, front_queries, grid_queries, layout_queries, operation_queries, record_queries, rule_queries, scalar_queries, span_queries, stream_queries, structure_queries, validation_queries, zone_queries):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared against detected language, counted."""
    return scalar_queries.lang_confusion(spark, sf_dir)
