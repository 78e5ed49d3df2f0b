"""Printed odds ratios, standard errors and marked claim blocks."""

import json
import random
from decimal import ROUND_HALF_UP, Decimal, getcontext

from tallyproof.operators import certificates, claims, statistic_tables
from tallyproof.sources import articles
from tests.test_checkers import leaf, leaves_of
from tests.test_percent_tables import article, table, tr

HEAD = tr("Outcome", "Exposed event", "Exposed non-event", "Unexposed event", "Unexposed non-event", "Unadjusted odds ratio (exposed vs unexposed)", tag="th")
SAID = "Independent groups: 30-day mortality"
SE_HEAD, SE_SAID = tr("Measure", "n", "SD", "SE", tag="th"), "Independent observations; SE = SD/sqrt(n)."


def tables_of(spark, **docs):
    df = spark.createDataFrame(list(docs.items()), "doc_id string, content binary")
    return articles.exploded(articles.layouts(df), "tables")


def test_odds_ratios(spark):
    row = lambda *x: tr("30-day mortality", *x)
    got = statistic_tables.odds_ratio_tables(tables_of(
        spark, off=article(table(row("12", "88", "6", "94", "2.20"), HEAD, SAID)), ok=article(table(row("12", "88", "6", "94", "2.14"), HEAD, SAID)), zero=article(table(row("0", "88", "6", "94", "2.14"), HEAD, SAID)),
        paired=article(table(row("12", "88", "6", "94", "2.14"), HEAD, SAID + ", matched pairs")), silent=article(table(row("12", "88", "6", "94", "2.14"), HEAD, "30-day mortality")),
        two=article(table(row("1", "2", "3", "4", "0.7") * 2, HEAD, SAID)), time=article(table(tr("Death", "12", "88", "6", "94", "2.14"), HEAD, "Independent groups")), other=article(table(row("1"), tr("A", "B", tag="th"), "x")),
    )).collect()
    assert {r.doc_id: (r.status, r.recomputed, r.reason) for r in got} == {
        "off": ("ARITHMETIC_CANDIDATE", "2.14", None), "ok": ("CONSISTENT_WITH_ROUNDING", "2.14", None), "zero": ("UNSUPPORTED", None, "ZERO_CELL_POLICY_UNSPECIFIED"),
        "paired": ("UNSUPPORTED", None, "MODEL_ADJUSTED_WEIGHTED_OR_COMPLEX_CONTEXT"), "silent": ("UNSUPPORTED", None, "INDEPENDENT_GROUPS_NOT_EXPLICIT"),
        "two": ("UNSUPPORTED", None, "ONE_OUTCOME_ROW_REQUIRED"), "time": ("UNSUPPORTED", None, "TIMEPOINT_UNSPECIFIED"),
    }


def test_standard_errors(spark):
    rows = tr("Score", "4", "6.0", "2.9") + tr("Other", "4", "6.0", "3.0") + tr("Wide", "4", "6", "3") + tr("Near", "3", "1", "0.7") + tr("Bad", "x", "6.0", "3.0")
    got = statistic_tables.se_tables(tables_of(spark, d=article(table(rows, SE_HEAD, SE_SAID)), silent=article(table(rows, SE_HEAD, "Means")))).collect()
    d = {r.row_label: (r.status, r.recomputed_se, r.reason) for r in got if r.doc_id == "d"}
    assert d == {
        "Score": ("ARITHMETIC_CANDIDATE", "3.0", None), "Other": ("CONSISTENT_WITH_ROUNDING", "3.0", None), "Wide": ("CONSISTENT_WITH_ROUNDING", "3", None),
        "Near": ("ROUNDING_COMPATIBLE", "0.6", None), "Bad": ("UNSUPPORTED", None, "N_NOT_A_POSITIVE_INTEGER"),
    }
    assert {r.reason for r in got if r.doc_id == "silent"} == {"EXPLICIT_INDEPENDENT_SE_FORMULA_REQUIRED"}


def test_se_rounding_against_decimals():
    getcontext().prec = 80
    rng = random.Random(2)
    for _ in range(3000):
        n, sd = rng.randint(1, 10 ** rng.randint(1, 9)), f"{rng.randint(0, 10**6)}.{rng.randint(0, 999):03d}"
        p = rng.randint(0, 8)
        want = (Decimal(sd) / Decimal(n).sqrt()).quantize(Decimal(1).scaleb(-p), rounding=ROUND_HALF_UP)
        status, text = statistic_tables.se_verdict(n, sd, format(want, "f"))
        assert (status, Decimal(text)) == ("CONSISTENT_WITH_ROUNDING", want)


def block(variables, goal, constraints, bound):
    return f"X-MATH-BEGIN v1\ndomain: bounded_real\nvariables: {variables}\nmaximize: {goal}\nconstraints: {constraints}\nupper_bound: {bound}\nX-MATH-END\n"


def test_claim_blocks(spark):
    texts = {
        "bilinear": "Note.\n" + block("x[0,1]; y[0,1]; z[0,1]", "z", "x + y == 1; z == x*y", "1/4"), "linear": block("x[-1,2]; y[0,3]", "3*x + 2*y + 5", "x + y <= 2", "11"), "refuted": block("x[0,1]", "x", "none", "1/2"),
        "none": "Nothing marked.", "open": "X-MATH-BEGIN v1\n", "bad": block("x[0,1]", "x*x", "none", "1"), "swapped": block("x[0,1]", "x", "none", "1").replace("maximize", "minimize"),
    }
    got = {r.doc_id: r for r in claims.compile_blocks(spark.createDataFrame(list(texts.items()), "doc_id string, text string")).collect()}
    assert {k: (r.result, r.code) for k, r in got.items()} == {
        "bilinear": ("needs_certificate", None), "linear": ("needs_certificate", None), "refuted": ("bound_refuted", None), "none": (None, "NO_EXPLICIT_CLAIM"), "open": (None, "UNCLOSED_CLAIM_MARKER"),
        "bad": (None, "UNSUPPORTED_SENTENCE_MATH"), "swapped": (None, "CLAIM_LINE_SHAPE"),
    }
    model = json.loads(got["linear"].model)
    assert certificates.verify(leaves_of(spark, [leaf([0], [1], [[0, "2"]])]), model, got["linear"].claimed)["verified_upper"] == "11"
