"""Conditional values from group sizes outside tables."""

from tallyproof.operators import percent_tables, populations
from tallyproof.sources import articles
from tests.test_percent_tables import HEAD, article, table, tr

ROWS = tr("Yes", "38 (92.6)") + tr("No", "3 (7.3)")


def test_conditional_values(spark):
    docs = {
        "named": article(table(ROWS, HEAD, "Outcomes of the intervention group"), text="<p>The interventional group (n=41) and the control group (n=43).</p>"),
        "turned": article(table(ROWS, HEAD, "Outcomes of the non-intervention group"), text="<p>The intervention group (n=41).</p>"),
        "heads": article(table(ROWS, tr("Outcome", "Control group, n (%)", tag="th"), "The intervention group"), text="<p>The intervention group (n=41) and the control group (n=50).</p>"),
        "twice": article(table(ROWS, HEAD, "The intervention group"), text="<p>The intervention group (n=41).</p><p>The intervention group (n=40).</p>"),
        "own": article(table(ROWS, HEAD, "N=41, the intervention group"), text="<p>The intervention group (n=41).</p>"),
        "many": article(table(ROWS, HEAD, "The intervention group"), text="".join(f"<p>The intervention group (n={k + 1}).</p>" for k in range(70))),
    }
    parsed = articles.layouts(spark.createDataFrame(list(docs.items()), "doc_id string, content binary"))
    got = populations.conditional_values(percent_tables.relations(parsed), parsed).orderBy("doc_id", "relation_ix").collect()
    assert [(r.doc_id, r.label, r.conditional_denominator, r.rounded_percent, r.matches, r.conflicting) for r in got] == [
        ("heads", "control group", 50, "76.0", False, False), ("heads", "control group", 50, "6.0", False, False),
        ("named", "intervention group", 41, "92.7", False, False), ("named", "intervention group", 41, "7.3", True, False),
        ("twice", "intervention group", None, None, None, True), ("twice", "intervention group", None, None, None, True),
    ]
