"""Registered queries of the exact arithmetic operators, over the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyproof.functions import exact

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "pct_recalc_by_flag",
    """
WITH g AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL),
w AS (SELECT *, CAST(sum(n) OVER (PARTITION BY l_returnflag) AS BIGINT) AS d FROM g),
k AS (SELECT *, (200 * n * 100 + d) // (2 * d) AS units FROM w),
r AS (SELECT *, units + n % 3 AS shown FROM k)
SELECT l_returnflag, l_linestatus, n, d,
  CAST(shown // 100 AS VARCHAR) || '.' || lpad(CAST(shown % 100 AS VARCHAR), 2, '0') AS reported_percent,
  CAST(units // 100 AS VARCHAR) || '.' || lpad(CAST(units % 100 AS VARCHAR), 2, '0') AS expected_percent,
  CAST(100 * n AS VARCHAR) || '/' || CAST(d AS VARCHAR) AS exact_ratio,
  CASE WHEN shown > 10000 THEN 'scope_ambiguous' WHEN shown = units THEN 'arithmetic_match' ELSE 'arithmetic_mismatch_candidate' END AS status
FROM r""",
)
def pct_recalc_by_flag(spark, sf_dir):
    """Counts against their group's total, with a printed percentage that is off by 0 to 2 units."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    rows = rows.withColumn("d", F.sum("n").over(Window.partitionBy("l_returnflag")))
    units, p = exact.percent_units("n", "d", 2), F.lit(2)
    shown = exact.print_units(units + F.col("n") % 3, p)
    rows = rows.withColumn("reported_percent", shown).withColumn("expected_percent", exact.print_units(units, p))
    return rows.withColumn("exact_ratio", exact.ratio_text("n", "d")).withColumn(
        "status", exact.percent_status("n", "d", F.col("reported_percent"))
    )


@query(
    "pct_numerator_range",
    """
WITH g AS (SELECT l_suppkey, count(*) AS d, count(*) FILTER (l_returnflag = 'R') AS n FROM lineitem GROUP BY l_suppkey),
k AS (SELECT *, (200 * n * 10 + d) // (2 * d) AS units FROM g)
SELECT l_suppkey, n, d, units,
  greatest(0, CASE WHEN 2 * units - 1 > 0 THEN ((2 * units - 1) * d + 1999) // 2000 ELSE 0 END) AS least,
  least(d, ((2 * units + 1) * d + 1999) // 2000 - 1) AS most
FROM k""",
)
def pct_numerator_range(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count("*").alias("d"), F.count_if(F.col("l_returnflag") == "R").alias("n")
    )
    rows = rows.withColumn("units", exact.percent_units("n", "d", 1)).withColumn("r", exact.numerator_range("d", "units", 1))
    return rows.select("l_suppkey", "n", "d", "units", "r.least", "r.most")


@query(
    "pct_denominator_range",
    """
WITH g AS (SELECT l_partkey, count(*) AS d, count(*) FILTER (l_linestatus = 'O') AS n FROM lineitem GROUP BY l_partkey),
k AS (SELECT *, (200 * n + d) // (2 * d) AS units FROM g WHERE n > 0)
SELECT l_partkey, n, d, units, greatest(n, (200 * n) // (2 * units + 1) + 1) AS least,
  CASE WHEN 2 * units - 1 > 0 THEN least(999999999, (200 * n) // (2 * units - 1)) ELSE 999999999 END AS most
FROM k""",
)
def pct_denominator_range(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.count("*").alias("d"), F.count_if(F.col("l_linestatus") == "O").alias("n")
    )
    rows = rows.where("n > 0").withColumn("units", exact.percent_units("n", "d", 0))
    return rows.withColumn("r", exact.denominator_range("n", "units", 0)).select("l_partkey", "n", "d", "units", "r.least", "r.most")


@query(
    "rounded_components",
    """
WITH g AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL),
w AS (SELECT *, CAST(sum(n) OVER (PARTITION BY o_orderpriority) AS BIGINT) AS d FROM g),
k AS (SELECT *, (20000 * n + d) // (2 * d) AS units FROM w)
SELECT o_orderpriority, CAST(sum(units) AS BIGINT) AS rounded_sum, CAST(sum(n) AS BIGINT) AS total, max(d) AS d,
  (20000 * CAST(sum(n) AS BIGINT) + max(d)) // (2 * max(d)) AS aggregate_units,
  CAST(sum(units) AS BIGINT) = (20000 * CAST(sum(n) AS BIGINT) + max(d)) // (2 * max(d)) AS sums_agree
FROM k GROUP BY o_orderpriority""",
)
def rounded_components(spark, sf_dir):
    """Components rounded one by one against their rounded sum."""
    g = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    w = g.withColumn("d", F.sum("n").over(Window.partitionBy("o_orderpriority")))
    k = w.withColumn("units", exact.percent_units("n", "d", 2)).groupBy("o_orderpriority")
    k = k.agg(F.sum("units").alias("rounded_sum"), F.sum("n").alias("total"), F.max("d").alias("d"))
    k = k.withColumn("aggregate_units", exact.percent_units("total", "d", 2))
    return k.withColumn("sums_agree", F.col("rounded_sum") == F.col("aggregate_units"))


def _two_by_two(measure: str):
    def run(spark, sf_dir):
        li = table(spark, sf_dir, "lineitem")
        cell = lambda f, s: F.count_if((F.col("l_returnflag") == f) & (F.col("l_linestatus") == s))
        rows = li.groupBy("l_suppkey").agg(cell("R", "F").alias("a"), cell("R", "O").alias("b"), cell("N", "F").alias("c"), cell("N", "O").alias("d"))
        return rows.withColumn("r", exact.two_by_two("a", "b", "c", "d", measure, 4)).select("l_suppkey", "a", "b", "c", "d", "r.units", "r.reason")

    return run


_PARTS = {
    "OR": ("a * d", "b * c", "CASE WHEN b = 0 OR c = 0 THEN 'ZERO_CELL_POLICY_UNSPECIFIED' END"),
    "RR": ("a * (c + d)", "c * (a + b)", "CASE WHEN c = 0 THEN 'ZERO_REFERENCE_RISK' END"),
    "RD": ("a * (c + d) - c * (a + b)", "(a + b) * (c + d)", "NULL"),
}
for _m, (_num, _den, _zero) in _PARTS.items():
    query(
        f"two_by_two_{_m.lower()}",
        f"""
WITH t AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS a, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'O') AS b,
  count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'F') AS c, count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'O') AS d FROM lineitem GROUP BY l_suppkey),
r AS (SELECT *, CAST({_num} AS HUGEINT) * 10000 AS num, CAST({_den} AS HUGEINT) AS den,
  CASE WHEN a + b = 0 OR c + d = 0 THEN 'ZERO_GROUP_TOTAL' ELSE {_zero} END AS reason FROM t)
SELECT l_suppkey, a, b, c, d, reason,
  CASE WHEN reason IS NULL THEN CAST((CASE WHEN num < 0 THEN -1 ELSE 1 END) * ((2 * abs(num) + den) // (2 * den)) AS BIGINT) END AS units
FROM r""",
    )(_two_by_two(_m))


@query(
    "sd_se_interval",
    """
WITH g AS (SELECT o_custkey, count(*) AS n, CAST(floor(max(o_totalprice)) AS BIGINT) % 9000 + 500 AS sd FROM orders GROUP BY o_custkey),
s AS (SELECT *, CAST(floor(sd / sqrt(n)) AS BIGINT) + (o_custkey % 5) - 2 AS se FROM g)
SELECT o_custkey, n, sd, se,
  CASE WHEN (2 * sd + 1) * (2 * sd + 1) > CAST(n AS HUGEINT) * greatest(2 * se - 1, 0) * greatest(2 * se - 1, 0)
        AND greatest(2 * sd - 1, 0) * greatest(2 * sd - 1, 0) < CAST(n AS HUGEINT) * (2 * se + 1) * (2 * se + 1)
  THEN 'ROUNDING_COMPATIBLE' ELSE 'ARITHMETIC_CANDIDATE' END AS status
FROM s WHERE se >= 0""",
)
def sd_se_interval(spark, sf_dir):
    """Can a printed SD, n and SE stand for values with SE = SD / sqrt(n): exact comparison of squares."""
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("n"), (F.floor(F.max("o_totalprice")).cast("bigint") % 9000 + 500).alias("sd")
    )
    s = g.withColumn("se", F.floor(F.col("sd") / F.sqrt("n")).cast("bigint") + F.col("o_custkey") % 5 - 2).where("se >= 0")
    wide = "decimal(38,0)"
    n, sd, se = (F.col(c).cast("decimal(18,0)").cast(wide) for c in ("n", "sd", "se"))
    low = lambda x: F.greatest(2 * x - 1, F.lit(0).cast(wide))
    meets = ((2 * sd + 1) * (2 * sd + 1) > n * low(se) * low(se)) & (low(sd) * low(sd) < n * (2 * se + 1) * (2 * se + 1))
    return s.withColumn("status", F.when(meets, "ROUNDING_COMPATIBLE").otherwise("ARITHMETIC_CANDIDATE"))
