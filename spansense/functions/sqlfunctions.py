"""Finders as SQL functions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udf, udtf

from spansense.functions.units import SPAN, find


@udtf(returnType="start int, end int, text string, unit string")
class FindUnits:
    """``find_units(text, unit)`` as a table: one row per span."""

    def eval(self, text: str, unit: str) -> Iterator[tuple]:
        yield from (tuple(s) for s in find(text, unit))


def register(spark: SparkSession) -> None:
    """Makes ``find_units`` (a table), ``spans_of`` (an array) and ``outcome_band`` known to SQL."""
    spark.udtf.register("find_units", FindUnits)
    spark.udf.register("spans_of", udf(lambda t, u: [tuple(s) for s in find(t, u)], SPAN, useArrow=True))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION outcome_band(p DOUBLE) RETURNS STRING RETURN CASE WHEN p >= 0.9 THEN 'yes' WHEN p <= 0.1 THEN 'no' WHEN p IS NOT NULL THEN 'review' END")
