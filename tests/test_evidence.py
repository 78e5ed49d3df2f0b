"""Flow graphs, cases, gates, prose and number roles, certificate points."""

import json

import pytest
from pyspark.sql import functions as F

from tallyproof.functions.rationals import Invalid
from tallyproof.operators import cases, certificates, flow_graph, projection, scoring
from tests.test_checkers import MODELS


def test_flow_graph_refusals_in_order(spark):
    n = lambda i, c=5, s="s": (i, c, s)
    e = lambda a, b, op, ok=True: (a, b, op, True, ok, True)
    add = [e("a", "r", "add"), e("b", "r", "sum")]
    graphs = [
        ("sum", [n("a"), n("b"), n("r", 10)], add, ("add", ["a", "b"], "r", True)), ("off", [n("a"), n("b"), n("r", 11)], add, ("add", ["a", "b"], "r", True)),
        ("twice", [n("a"), n("a"), n("r")], add, ("add", ["a", "b"], "r", True)), ("gone", [n("a"), n("r")], add, ("add", ["a", "b"], "r", True)), ("shape", [n("a"), n("b"), n("r")], add, ("add", ["a", "a"], "r", True)),
        ("count", [n("a", -1), n("b"), n("r")], add, ("add", ["a", "b"], "r", True)), ("scope", [n("a", 5, None), n("b", 5, None), n("r", 10, None)], add, ("add", ["a", "b"], "r", True)),
        ("silent", [n("a"), n("b"), n("r", 10)], add, ("add", ["a", "b"], "r", False)), ("name", [n("a"), n("b"), n("r", 10)], [e("a", "r", "add"), e("b", "r", "subtract")], ("add", ["a", "b"], "r", True)),
        ("three", [n("a", 9), n("b", 2), n("c", 3), n("r", 4)], [e("a", "b", "remove_duplicates"), e("a", "c", "subtract"), e("a", "r", "subtract")], ("subtract", ["a", "b", "c"], "r", True)),
    ]
    df = spark.createDataFrame(graphs, f"k string, nodes array<{flow_graph.NODE}>, edges array<{flow_graph.EDGE}>, operation {flow_graph.OPERATION}")
    got = {r.k: (r.status, r.reason, r.expected, r.difference) for r in flow_graph.check(df).collect()}
    refused = lambda reason: ("FLOW_RELATION_AMBIGUOUS", reason, None, None)
    assert got == {
        "sum": ("FLOW_BALANCED", None, 10, 0), "off": ("FLOW_ARITHMETIC_CANDIDATE", None, 10, 1), "three": ("FLOW_BALANCED", None, 4, 0), "twice": refused("DUPLICATE_FLOW_NODE_ID"), "gone": refused("FLOW_NODE_MISSING"),
        "shape": refused("FLOW_OPERATION_SHAPE_UNSUPPORTED"), "count": refused("FLOW_COUNT_OUT_OF_BOUNDS"), "scope": refused("SCOPE_MISMATCH_OR_INCOMPLETE"), "silent": refused("FLOW_GRAPH_DOES_NOT_MATCH_OPERATION"),
        "name": refused("OVERLAP_NOT_RULED_OUT_OR_RELATION_NOT_EXPLICIT"),
    }


def test_cases_that_are_no_objects_and_digests(spark):
    h = "a" * 64
    sound = {
        "schema_version": "1.0", "case_id": "c", "artifacts": {"s": h, "w": h, "notes": h}, "witness_artifact": "w", "unresolved_objections": [], "disclosure": "private",
        "source": {"artifact": "s", "text_artifact": "s", "identifier": "i", "version": "1", "capture_status": "captured", "correction_check": {"checked_on": "2026-01-02", "status": "unchecked", "evidence_artifact": "s"}},
        "claim": {"id": "k", "statement": "It is.", "scope": "All", "assumptions": ["a"], "excluded_claims": ["b"], "anchor": {"offset": 0, "quote": "It"}, "formalization": {"kind": "finite_pmf_bound"}},
    }
    rows = [("sound", json.dumps(sound)), ("notes", json.dumps(sound | {"artifacts": {"s": h, "w": h, "notes": "b" * 64}})), ("witness", json.dumps(sound | {"artifacts": {"s": h, "w": "b" * 64, "notes": h}})), ("text", "no"), ("null", None), ("list", "[]"), ("path", json.dumps(sound | {"artifacts": {"s": h, "w": h, "../x": h}}))]
    found = cases.validate(spark.createDataFrame(rows, "k string, case string"))
    got = {r.k: r.violations for r in found.collect()}
    assert got == {"sound": [], "notes": [], "witness": [], "text": ["NOT_AN_OBJECT"], "null": ["NOT_AN_OBJECT"], "list": ["NOT_AN_OBJECT"], "path": ["ARTIFACT_PATH"]}
    digests = {r.k: r.subject_sha256 for r in cases.subject_digest(found).collect()}
    # An artifact that the claim doesn't rest on leaves the digest as it is.
    assert digests["sound"] == digests["notes"] != digests["witness"]


def test_gates(spark):
    names = "k positive wins losses negative candidate_alarms baseline_alarms unknown minimum_positive minimum_negative alpha safety_alpha margin gain".split()
    base = dict(zip(names, ("met", 100, 30, 5, 200, 2, 2, 0, 50, 50, "1/40", "1/40", "1/10", "1/10"), strict=True))
    rows = [base, base | {"k": "open", "unknown": 1}, base | {"k": "even", "losses": 25}, base | {"k": "harm", "candidate_alarms": 60}, base | {"k": "few", "minimum_positive": 101}, base | {"k": "large", "positive": 3000}]
    got = {r.k: r for r in scoring.family_gates(spark.createDataFrame(rows)).collect()}
    assert {k: r.numeric_thresholds for k, r in got.items()} == {"met": "met_on_unverified_development_data", "open": "not_evaluated", "large": "not_evaluated"} | dict.fromkeys(("even", "harm", "few"), "not_met_or_sample_inadequate")
    assert (got["met"].significant, got["met"].practical, got["met"].safe) == (True, True, True) and not got["even"].significant and not got["harm"].safe and got["open"].p_upper is None
    assert got["large"].reasons == ["NO_ENDPOINT_DATA_OR_SIZE_LIMIT"] and got["few"].reasons == ["DECLARED_MINIMUM_SAMPLE_NOT_MET", "STATISTICAL_OR_PRACTICAL_THRESHOLD_NOT_MET"]


def test_number_roles(spark):
    rows = [("4 (8.0)", ["n (%)"]), ("4 (8.0)", ["Mean (SD)"]), ("4 (8.0%)", ["Mean"]), ("1,200/2,400 (50)", ["percent"]), ("12", ["No."]), ("12", ["Score"]), ("12.5%", ["Score"]), ("text", ["n (%)"])]
    df = spark.createDataFrame(rows, "text string, headers array<string>").withColumn("v", projection.numeric_values(F.col("text"), F.col("headers")))
    got = [[(v.exact, v.role, v.display_precision) for v in r.v] for r in df.collect()]
    assert got == [
        [("4", "count", None), ("8.0", "percent", 1)], [("4", None, None), ("8.0", None, 1)], [("4", "count", None), ("8.0", "percent", 1)], [("1200", "count", None), ("2400", "explicit_ratio_denominator", None), ("50", "percent", 0)],
        [("12", "count", 0)], [("12", None, 0)], [("12.5", "percent", 1)], [],
    ]


def test_points_of_certificate_models():
    half, linear = MODELS["half"][0], MODELS["linear"][0]
    assert certificates.point_value(half, ["1/2", "1/2", "1/4"]) == "1/4" and certificates.point_value(linear, ["2", "0"]) == "11"
    for model, values, code in ((half, ["1/2", "1/2"], "DIMENSION"), (half, ["2", "-1", "0"], "BOUNDS"), (half, ["1/2", "1/4", "1/8"], "EQUALITY"), (half, ["1/2", "1/2", "1/3"], "PRODUCT"), (linear, ["2", "1"], "INEQUALITY")):
        with pytest.raises(Invalid, match=f"POINT_{code}"):
            certificates.point_value(model, values)
