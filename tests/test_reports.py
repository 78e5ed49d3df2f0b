"""Registry constraints, outcome taxonomy and rendered reports."""

from tallyproof.operators import scoring
from tallyproof.sources import reports

SCHEMA = "doc_id string, relation_ix int, table_id string, status string, reason string, numerator bigint, denominator bigint, reported_percent string, expected_percent string"


def test_registry(spark):
    rows = [("a", "f", "s1", "positive", True), ("b", "f", "s2", "negative", True), ("c", "g", "s1", "positive", True), ("d", "h", "s3", "positive", True), ("d", "h", "s4", "positive", True)]
    df = spark.createDataFrame(rows, "work_id string, family string, source_sha256 string, label string, eligible boolean")
    got = {(r.work_id, r.violation) for r in scoring.registry_violations(df).collect()}
    assert got == {("a", "FAMILY_LABEL_NOT_CONSTANT"), ("b", "FAMILY_LABEL_NOT_CONSTANT"), ("a", "SOURCE_IN_SEVERAL_FAMILIES"), ("c", "SOURCE_IN_SEVERAL_FAMILIES"), ("d", "DUPLICATE_WORK")}


def test_taxonomy(spark):
    rows = [(50, 40, "arithmetic_match", None), (50, None, None, None), (50, None, "scope_ambiguous", "unsupported_header_spans"), (50, None, "scope_ambiguous", "no_explicit_denominator"), (50, 50, "arithmetic_match", None), (50, 50, "rounding_ambiguous", "source_rounding_convention_not_modeled")]
    df = spark.createDataFrame(rows, "denominator bigint, found_denominator bigint, status string, reason string")
    assert [r.outcome for r in scoring.taxonomy(df).collect()] == ["wrong_denominator", "missing", "table_layout", "other_reason", "supported", "rounding"]


def test_reports_are_escaped_and_in_order(spark):
    rows = [("d<1>", 2, "T|2", "arithmetic_match", None, 4, 50, "8.0", "8.0"), ("d<1>", 1, "<b>&'\"", "scope_ambiguous", "no_explicit_denominator", 4, None, "8.0", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    page, text = reports.html(df).first().html, reports.markdown(df).first().markdown
    assert "<b>" not in page and "&lt;b&gt;&amp;&#x27;&quot;" in page and page.index("scope_ambiguous") < page.index("arithmetic_match")
    assert "T\\|2" in text and "\\<b\\>" in text and text.splitlines()[6].startswith("| 1 |") and "arithmetic\\_match" in text
