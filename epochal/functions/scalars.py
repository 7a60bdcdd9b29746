"""Escapes, random numbers, versions and the names under which SQL finds the library's functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

VERSION = (0, 2, 0)


def version() -> str:
    return ".".join(map(str, VERSION))


def version_number(major: int = VERSION[0], minor: int = VERSION[1], patch: int = VERSION[2]) -> int:
    return major * 1_000_000 + minor * 1000 + patch


def uri_escaped(path: Column) -> Column:
    """A path within a URI: the characters that would end it, and the escape's own, in hexadecimal."""
    for char, code in (("%", "%25"), ("?", "%3F"), ("#", "%23")):
        path = F.replace(path, F.lit(char), F.lit(code))
    return path


def xorshift(x: Column) -> Column:
    """The next state of a 64-bit xorshift generator with the shifts 13, 7, 17."""
    x = x.bitwiseXOR(F.shiftleft(x, 13))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
    return x.bitwiseXOR(F.shiftleft(x, 17))


def linear_congruential(x: Column) -> Column:
    """The next state of a generator of 31 bits: 1103515245 x + 12345."""
    return (x * 1103515245 + 12345).bitwiseAND(0x7FFFFFFF)


def exponential(uniform: Column, mean: float) -> Column:
    """An exponential draw from a uniform one above 0."""
    return -F.lit(mean) * F.ln(uniform)


def type_name(value: Column) -> Column:
    """The storage type of a tagged value (see ``operators.diff.tagged``) by its usual name."""
    return F.when(value["t"] == "int", "integer").otherwise(value["t"])


def as_number(truth: Column) -> Column:
    """A truth value as 0 or 1; null stays null."""
    return truth.cast("int")


def whole_quotient(a: str, b: str) -> Column:
    """The quotient of two integer columns without its fraction, towards 0; null where b is 0."""
    return F.expr(f"CASE WHEN {b} <> 0 THEN {a} DIV {b} END")


#: SQL bodies of the functions that ``register`` makes known: name, arguments, type, body.
FUNCTIONS = (
    ("epochal_version", "", "STRING", f"'{version()}'"),
    ("epochal_version_number", "", "INT", str(version_number())),
    ("epochal_segment", "loc BIGINT", "BIGINT", "shiftrightunsigned(loc, 32)"),
    ("epochal_offset", "loc BIGINT", "BIGINT", "loc & 4294967295"),
    ("epochal_percent", "n BIGINT, total BIGINT", "DOUBLE", "CASE WHEN total > 0 THEN 100.0D * n / total ELSE 0.0D END"),
)


def register(spark: SparkSession) -> list[str]:
    """Makes the library's functions known to a session's SQL, as expressions that the optimizer sees through, and a
    table function of row numbers; gives their names."""
    for name, arguments, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION epochal_rows(first BIGINT, last BIGINT) RETURNS TABLE (i BIGINT) RETURN SELECT explode(sequence(first, last)) AS i")
    return [f[0] for f in FUNCTIONS] + ["epochal_rows"]
