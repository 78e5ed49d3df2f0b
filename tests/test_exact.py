"""Exact functions against Fraction arithmetic written for the tests, and published figures."""

import random
from fractions import Fraction as Fr
from math import ceil

import pytest
from pyspark.sql import functions as F

from tallyproof.functions import exact, rationals, statistics


def half_up(x: Fr) -> int:
    return (2 * x.numerator + x.denominator) // (2 * x.denominator)


def test_percent_and_ranges_against_fractions(spark):
    rng = random.Random(5)
    rows = [(63476215, 659255845, 6)]
    for _ in range(4000):
        d = rng.randint(1, 10 ** rng.randint(1, 9) - 1)
        rows.append((rng.randint(0, d), d, rng.randint(0, 6)))
    df = spark.createDataFrame(rows, "n bigint, d bigint, p int").withColumn("u", exact.percent_units("n", "d", "p"))
    df = df.withColumn("num", exact.numerator_range("d", "u", "p")).withColumn("den", exact.denominator_range("n", "u", "p")).withColumn("text", exact.print_units(F.col("u"), F.col("p")))
    for r in df.collect():
        s = 10**r.p
        assert r.u == half_up(Fr(100 * r.n * s, r.d))
        assert Fr(r.text) == Fr(r.u, s)
        low, high = Fr(2 * r.u - 1, 2) * r.d / (100 * s), Fr(2 * r.u + 1, 2) * r.d / (100 * s)
        assert (r.num.least, r.num.most) == (max(0, ceil(low)), min(r.d, ceil(high) - 1))
        if r.n:
            assert r.den.least <= r.d <= r.den.most
            for d, inside in ((r.den.least, True), (r.den.least - 1, False), (r.den.most, True), (r.den.most + 1, False)):
                if r.n <= d <= exact.MAX_COUNT:
                    assert (half_up(Fr(100 * r.n * s, d)) == r.u) is inside


def test_published_rounding_traps(spark):
    df = spark.createDataFrame([(63476215, 659255845, 6)], "n bigint, d bigint, p int")
    assert df.select(exact.print_units(exact.percent_units("n", "d", "p"), F.col("p"))).first()[0] == "9.628464"
    row = spark.range(1).select(exact.numerator_range(F.lit(8590), F.lit(812), F.lit(2)).alias("r"), exact.numerator_range(F.lit(8), F.lit(12), F.lit(0)).alias("q")).first()
    assert row.r.least == 698 and not row.q.feasible


@pytest.mark.parametrize("measure", ["RR", "OR", "RD"])
def test_two_by_two(spark, measure):
    rng = random.Random(measure)
    rows = [(0, 8, 1, 7)] + [tuple(rng.randint(0, 10 ** rng.randint(1, 7)) for _ in range(4)) for _ in range(300)]
    df = spark.createDataFrame(rows, "a bigint, b bigint, c bigint, d bigint").withColumn("r", exact.two_by_two("a", "b", "c", "d", measure, 2))
    for a, b, c, d, (units, reason) in df.collect():
        try:
            x = {"RR": lambda: Fr(a * (c + d), c * (a + b)), "OR": lambda: Fr(a * d, b * c), "RD": lambda: Fr(a, a + b) - Fr(c, c + d)}[measure]()
        except ZeroDivisionError:
            assert units is None and reason
            continue
        if reason is None:
            assert units == (half_up(abs(x) * 100) if x >= 0 else -half_up(abs(x) * 100))
    if measure == "RD":
        assert df.first().r.units == -13


def test_statistics_figures():
    assert rationals.outward(statistics.discordance_p(6, 0), True) == "0.015625000000"
    assert Fr("0.0496") < statistics.harm_upper(0, 0, 86, Fr(1, 40)) < Fr("0.0498") or statistics.zero_zero_minimum(Fr(1, 40), Fr(1, 20), 1, 200) == 86
    at = {"wins_rate": Fr(1, 4), "losses_rate": Fr(1, 10), "gain": Fr(1, 10), "alpha": Fr(1, 40)}
    n128, n129 = statistics.power(128, **at), statistics.power(129, **at)
    assert abs(float(n128) - 0.7992594458076103) < 1e-15 and abs(float(n129) - 0.8028103975131423) < 1e-15
    assert statistics.first_powered(126, 140, Fr(4, 5), **at)[0] == 129
    joint = statistics.safety_pass(86, (Fr("0.98"), Fr("0.005"), Fr("0.01"), Fr("0.005")), Fr(1, 40), Fr(1, 20))
    assert f"{float(joint) * 100:.4f}" == "42.1702" and f"{float(joint * n129) * 100:.4f}" == "33.8546"
    assert statistics.least_enrolment(129, Fr(9, 10), Fr("0.975"), 300) == 152 and statistics.least_enrolment(86, Fr(9, 10), Fr("0.975"), 300) == 102
    low, high = statistics.frechet(Fr("0.8028"), Fr("0.4217"))
    assert (low, high) == (Fr("0.2245"), Fr("0.4217"))


def test_tails_against_sums():
    from math import comb

    for n, k in ((5, 2), (12, 0), (12, 11)):
        for at in (1 << 38, 3 << 37):
            p = Fr(at, statistics.GRID)
            want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert Fr(statistics.grid_tail(n, k, at), statistics.GRID**n) == want == statistics.binomial_at_most(n, k, p)


def test_strict_json_and_canonical():
    for bad, code in (('{"a":1,"a":2}', "DUPLICATE_KEY"), ("[1.0]", "FLOAT_NOT_ACCEPTED"), ("[NaN]", "FLOAT_NOT_ACCEPTED"), ("[1", "MALFORMED_JSON"), ("[" * 70 + "]" * 70, "JSON_TOO_DEEP")):
        with pytest.raises(rationals.Invalid, match=code):
            rationals.strict_json(bad)
    assert rationals.canonical({"b": 1, "a": "é"}) == b'{"a":"\\u00e9","b":1}'
    assert rationals.canonical({"a": 1}, newline=True) == b'{"a":1}\n' and rationals.canonical({"a": 1}, indent=True) == b'{\n  "a": 1\n}\n'


def test_roots_enclose():
    for x in (Fr(2), Fr(9, 4), Fr(1, 3)):
        r = rationals.root(x, 20)
        assert r.low**2 <= x <= r.high**2 and r.high - r.low <= Fr(1, 10**20)
    assert rationals.root(Fr(9, 4)) == rationals.point(Fr(3, 2))
