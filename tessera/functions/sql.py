"""Scores as SQL functions: Catalyst sees through them, so they cost what the columns cost."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tessera.functions import constants as K


def register(spark: SparkSession) -> None:
    """Temporary functions recency_score(hours), frequency_score(count), confidence_factor(confidence) and blended(semantic, keyword)."""
    bands = " ".join(f"WHEN hours <= {h} THEN {s}D" for h, s in K.RECENCY_BANDS)
    functions = {
        "recency_score(hours DOUBLE)": f"CASE WHEN hours IS NULL THEN {K.OLDEST_RECENCY}D {bands} ELSE {K.OLDEST_RECENCY}D END",
        "frequency_score(n BIGINT)": "least(1D, log2(greatest(1, coalesce(n, 0))) / 10)",
        "confidence_factor(c DOUBLE)": "CASE WHEN c IS NULL THEN 1D ELSE least(1.05D, greatest(0.7D, 0.7D + (c - 0.1D) * 0.35D / 0.9D)) END",
        "blended(semantic DOUBLE, keyword DOUBLE)": "CASE WHEN semantic IS NOT NULL AND keyword IS NOT NULL THEN 0.9D * semantic + 0.1D * keyword WHEN semantic IS NOT NULL THEN semantic ELSE 0.1D * keyword END",
    }
    for signature, body in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS DOUBLE RETURN {body}")
