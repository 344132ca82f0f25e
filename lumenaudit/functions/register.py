"""SQL names for the vector functions, as SQL functions that stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import SparkSession

_DOT = "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v)"
_LENGTH = "sqrt(aggregate({c}, 0D, (s, v) -> s + v * v))"

FUNCTIONS = {
    "vec_dot": f"(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {_DOT}",
    "vec_norm": f"(a ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {_LENGTH.format(c='a')}",
    "cosine_sim": f"(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {_DOT} / nullif({_LENGTH.format(c='a')} * {_LENGTH.format(c='b')}, 0D)",
    "l2_dist": "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, v) -> s + v))",
}


def register_functions(spark: SparkSession) -> None:
    """Makes the functions available to ``spark.sql`` in this session."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
