"""Every query by name, with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import composing, curation, pages, parsing, relational, results, retrieval, scans, scoring, synthesis, writing

PLANS = (scoring, parsing, composing, results, curation, retrieval, writing, synthesis, scans, relational, pages)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.grounding_by_mode(spark, sf_dir)


def queries() -> dict:
    return {name: run for plan in PLANS for name, (run, _) in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in PLANS for name, (_, sql) in plan.QUERIES.items() if sql}
