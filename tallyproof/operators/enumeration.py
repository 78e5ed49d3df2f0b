"""Finite enumeration as joins and counts: grids over a field, colourings, maps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The largest field, the most variables and points of an enumeration.
MAX_PRIME, MAX_VARIABLES, MAX_POINTS = 251, 3, 2_000_000


def is_prime(p: int) -> bool:
    return p > 1 and all(p % d for d in range(2, int(p**0.5) + 1))


def grid(spark: SparkSession, p: int, variables: int) -> DataFrame:
    """All points (x0, ..) over the field of p elements, made from one range; its size is bounded by MAX_POINTS."""
    if not (is_prime(p) and p <= MAX_PRIME and 1 <= variables <= MAX_VARIABLES and p**variables <= MAX_POINTS):
        raise ValueError("field enumeration is out of bounds")
    n = p**variables
    rows = spark.range(0, n, 1, max(1, min(64, n // 20_000)))
    return rows.select(*((F.call_function("div", F.col("id"), F.lit(p**k)) % p).alias(f"x{k}") for k in range(variables)))


def power_mod(x: Column, exponent: int, p: int) -> Column:
    """x to a small power modulo p, by repeated squaring on BIGINT."""
    result, base = F.lit(1).cast("bigint"), x.cast("bigint")
    while exponent:
        if exponent & 1:
            result = result * base % p
        base, exponent = base * base % p, exponent >> 1
    return result


def polynomial(terms: list[tuple[int, tuple[int, ...]]], p: int) -> Column:
    """Sum of coefficient times powers of x0, .. modulo p."""
    parts = []
    for coefficient, powers in terms:
        part = F.lit(coefficient % p).cast("bigint")
        for k, e in enumerate(powers):
            if e:
                part = part * power_mod(F.col(f"x{k}"), e, p) % p
        parts.append(part)
    return reduce(lambda a, b: a + b, parts, F.lit(0).cast("bigint")) % p


def solutions(spark: SparkSession, p: int, variables: int, terms: list[tuple[int, tuple[int, ...]]]) -> DataFrame:
    """One row: how many points the polynomial is 0 at."""
    return grid(spark, p, variables).agg(F.count_if(polynomial(terms, p) == 0).alias("solutions"))


def coloring(edges: DataFrame, colors: DataFrame) -> DataFrame:
    """One row: edges (u, v), those whose ends share a colour, and the number of colours of (v, color)."""
    a = colors.select(F.col("v").alias("u"), F.col("color").alias("a"))
    b = colors.select("v", F.col("color").alias("b"))
    counted = edges.join(a, "u").join(b, "v").agg(F.count("*").alias("edges"), F.count_if(F.col("a") == F.col("b")).alias("clashes"))
    return counted.join(F.broadcast(colors.agg(F.countDistinct("color").alias("colors"))))


def fixed_points(rows: DataFrame) -> DataFrame:
    """One row about the map k -> v: its elements, fixed points, and values that aren't elements."""
    keys = rows.select(F.col("k").alias("v")).distinct().withColumn("inside", F.lit(True))
    return rows.join(keys, "v", "left").agg(
        F.count("*").alias("elements"), F.count_if(F.col("k") == F.col("v")).alias("fixed_points"), F.count_if(F.col("inside").isNull()).alias("outside")
    )
