"""Exact arithmetic on printed percentages and ratios, as column expressions on integers.

Nothing here passes through a binary float or a rounded decimal quotient. Domains are such that
every product fits a BIGINT: counts up to 999,999,999 and up to 6 printed decimals.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest count and the most printed decimals that are accepted.
MAX_COUNT = 999_999_999
MAX_DECIMALS = 6


def big(c) -> Column:
    return (F.lit(c) if isinstance(c, int) else F.col(c) if isinstance(c, str) else c).cast("bigint")


def idiv(a: Column, b: Column) -> Column:
    """Integer quotient of a nonnegative a by a positive b; null where b is 0."""
    return F.when(b != 0, F.call_function("div", a, F.when(b != 0, b)))


def power_of_ten(decimals: Column) -> Column:
    return F.element_at(F.array(*(F.lit(10**k).cast("bigint") for k in range(10))), decimals.cast("int") + 1)


def decimals_of(text: Column) -> Column:
    """Printed decimals of a number's text: trailing zeros count."""
    return F.length(F.regexp_extract(text, r"^[0-9]{1,3}(?:\.([0-9]{1,6}))?$", 1)).cast("int")


def scaled(text: Column) -> Column:
    """The digits of a printed number as an integer, its point taken out; null for other texts."""
    ok = F.regexp_like(text, F.lit(r"^[0-9]{1,3}(\.[0-9]{1,6})?$"))
    return F.when(ok, F.replace(text, F.lit("."), F.lit("")).cast("bigint"))


def percent_units(n, d, decimals) -> Column:
    """100 n / d in units of the last printed decimal, half up: (200 n 10^p + d) div 2 d."""
    n, d, s = big(n), big(d), power_of_ten(big(decimals))
    return idiv(200 * n * s + d, 2 * d)


def print_units(units: Column, decimals: Column) -> Column:
    """An integer of units of 10^-p as text with p decimals."""
    s = power_of_ten(decimals)
    size = F.abs(units)
    head = F.concat(F.when(units < 0, F.lit("-")).otherwise(F.lit("")), idiv(size, s).cast("string"))
    tail = F.lpad((size % s).cast("string"), decimals.cast("int"), "0")
    return F.when(decimals == 0, head).otherwise(F.concat(head, F.lit("."), tail))


def in_domain(n, d, decimals) -> Column:
    n, d, p = big(n), big(d), big(decimals)
    return F.coalesce((n >= 0) & (d > 0) & (n <= d) & (d <= MAX_COUNT) & p.between(0, MAX_DECIMALS), F.lit(False))


def ratio_text(n, d) -> Column:
    """The exact percentage as an unreduced fraction."""
    return F.concat((100 * big(n)).cast("string"), F.lit("/"), big(d).cast("string"))


def print_status(n, d, reported: Column) -> Column:
    """Does a printed percentage equal its recomputation, above 100 and for any count; null where the text is no printed number."""
    same = percent_units(n, d, decimals_of(reported)) == scaled(reported)
    return F.when(same, F.lit("arithmetic_match")).when(~same, F.lit("arithmetic_mismatch_candidate"))


def percent_status(n, d, reported: Column) -> Column:
    """Does a printed percentage equal its recomputation; outside the domain there is no verdict."""
    p = decimals_of(reported)
    known = in_domain(n, d, p) & (scaled(reported) <= 100 * power_of_ten(p))
    return F.when(~F.coalesce(known, F.lit(False)), F.lit("scope_ambiguous")).otherwise(print_status(n, d, reported))


def ceil_div(a: Column, b: Column) -> Column:
    """Quotient rounded up, for a > 0; 0 for a <= 0, which is the lower end of every range here."""
    return F.when(a > 0, idiv(a + b - 1, b)).otherwise(F.lit(0).cast("bigint"))


def numerator_range(d, units, decimals) -> Column:
    """(least, most) counts of d that print as this percentage: lower half unit inside, upper outside."""
    d, k, s = big(d), big(units), power_of_ten(big(decimals))
    least = F.greatest(F.lit(0).cast("bigint"), ceil_div((2 * k - 1) * d, 200 * s))
    most = F.least(d, ceil_div((2 * k + 1) * d, 200 * s) - 1)
    return F.struct(least.alias("least"), most.alias("most"), (least <= most).alias("feasible"))


def denominator_range(n, units, decimals) -> Column:
    """(least, most) denominators for which n of them print as this percentage, for n > 0."""
    n, k, s = big(n), big(units), power_of_ten(big(decimals))
    least = F.greatest(n, idiv(200 * n * s, 2 * k + 1) + 1)
    most = F.when(2 * k - 1 > 0, F.least(F.lit(MAX_COUNT).cast("bigint"), idiv(200 * n * s, 2 * k - 1))).otherwise(F.lit(MAX_COUNT).cast("bigint"))
    return F.struct(least.alias("least"), most.alias("most"), (least <= most).alias("feasible"))


def half_away(num: Column, den: Column) -> Column:
    """num / den to the nearest integer, ties away from zero; DECIMAL(38,0) operands, den > 0."""
    big_int = "decimal(38,0)"
    size = F.abs(num).cast(big_int) * 2 + den.cast(big_int)
    twice = (den.cast(big_int) * 2).cast(big_int)
    # div gives a wrapped BIGINT on wide decimals; taking the remainder off first makes the quotient exact.
    whole = ((size - size % twice) / twice).cast("decimal(38,0)").cast("bigint")
    return F.when(num < 0, -whole).otherwise(whole)


def two_by_two(a, b, c, d, measure: str, decimals: int | Column) -> Column:
    """(units, reason) of a risk ratio, odds ratio or risk difference at so many decimals, 8 at most.

    a, b: events and others of the first group; c, d: of the reference group.
    """
    a, b, c, d = (big(x).cast("decimal(38,0)") for x in (a, b, c, d))
    s = (F.lit(10**decimals) if isinstance(decimals, int) else power_of_ten(decimals)).cast("decimal(38,0)")
    first, second = a + b, c + d
    if measure == "RR":
        num, den, zero = a * second, c * first, F.when(c == 0, F.lit("ZERO_REFERENCE_RISK"))
    elif measure == "OR":
        num, den, zero = a * d, b * c, F.when((b == 0) | (c == 0), F.lit("ZERO_CELL_POLICY_UNSPECIFIED"))
    elif measure == "RD":
        num, den, zero = a * second - c * first, first * second, F.lit(None).cast("string")
    else:
        return F.struct(F.lit(None).cast("bigint").alias("units"), F.lit("STATISTIC_TYPE_UNSUPPORTED").alias("reason"))
    reason = F.coalesce(F.when((first == 0) | (second == 0), F.lit("ZERO_GROUP_TOTAL")), zero)
    units = F.when(reason.isNull(), half_away((num * s).cast("decimal(38,0)"), F.when(den > 0, den).otherwise(1).cast("decimal(38,0)")))
    return F.struct(units.alias("units"), reason.alias("reason"))
