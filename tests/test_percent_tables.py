"""Goldens of the table detector, one article a case."""

import pytest

from tallyproof.operators import percent_tables
from tallyproof.sources import articles


def article(*tables: str, text: str = "") -> bytes:
    return f"<article><body>{text}{''.join(tables)}</body></article>".encode()


def table(rows: str, head: str = "", caption: str = "", foot: str = "", ident: str = "T1") -> str:
    head = f"<thead>{head}</thead>" if head else ""
    foot = f"<table-wrap-foot><p>{foot}</p></table-wrap-foot>" if foot else ""
    return f'<table-wrap id="{ident}"><caption><p>{caption}</p></caption><table>{head}<tbody>{rows}</tbody></table>{foot}</table-wrap>'


def tr(*cells: str, tag: str = "td") -> str:
    return "<tr>" + "".join(c if c.startswith("<t") else f"<{tag}>{c}</{tag}>" for c in cells) + "</tr>"


HEAD = tr("Outcome", "Patients, n (%)", tag="th")
CASES = {
    "caption": (article(table(tr("A", "4 (8.00)") + tr("B", "4 (8.10)"), HEAD, "Trial, N=50")), [("arithmetic_match", None, 50, "table_caption_or_footnote", "8.00"), ("arithmetic_mismatch_candidate", None, 50, "table_caption_or_footnote", "8.00")]),
    "groups": (
        article(table(tr("A", "5 (10)", "10 (20)", "4 (10)", "8 (20)"), "<tr><th></th><th colspan='2'>Drug N=50, n (%)</th><th colspan='2'>Placebo N=40, n (%)</th></tr>")),
        [("arithmetic_match", None, 50, "column_header", "10"), ("arithmetic_match", None, 50, "column_header", "20"), ("arithmetic_match", None, 40, "column_header", "10"), ("arithmetic_match", None, 40, "column_header", "20")],
    ),
    "commas": (article(table(tr("A", "7,362 (2.4)"), HEAD, "N=304,997")), [("arithmetic_match", None, 304997, "table_caption_or_footnote", "2.4")]),
    "none": (article(table(tr("A", "3 (10.0%)"), HEAD, "No total")), [("scope_ambiguous", "no_explicit_denominator", None, None, None)]),
    "ratio": (
        article(table(tr("A", "11/233 (1.8%)") + tr("B", "0/40 (0.00%)") + tr("C", "0/0 (0.0%)"), HEAD)),
        [("arithmetic_mismatch_candidate", None, 233, "cell_ratio", "4.7"), ("arithmetic_match", None, 40, "cell_ratio", "0.00"), ("scope_ambiguous", "nonpositive_denominator", None, None, None)],
    ),
    "row_groups": (
        article(table("<tr><td colspan='2'>Men N=40</td></tr>" + tr("A", "4 (10.0)") + "<tr><td colspan='2'>Women N=60</td></tr>" + tr("A", "6 (10.0)"), HEAD, "All N=100")),
        [("arithmetic_match", None, 40, "row_group", "10.0"), ("arithmetic_match", None, 60, "row_group", "10.0")],
    ),
    "two_captions": (article(table(tr("A", "4 (8.0)"), HEAD, "N=50 of N=60")), [("scope_ambiguous", "multiple_unscoped_table_denominators", None, None, None)]),
    "missing": (
        article(table("<tr><td colspan='2'>Age n (%)</td></tr>" + tr("Young", "50 (50)") + tr("Missing", "1 (&lt;1%)") + "<tr><td colspan='2'>Region n (%)</td></tr>" + tr("North", "20 (20)"), HEAD, "N=100")),
        [("scope_ambiguous", "missing_data_denominator_scope_unclear", None, None, None), ("arithmetic_match", None, 100, "table_caption_or_footnote", "20")],
    ),
    "columns": (article(table(tr("A", "4", "50", "8.0"), tr("Item", "n", "N", "%", tag="th"))), [("arithmetic_match", None, 50, "row_denominator_column", "8.0")]),
    "rounding": (article(table(tr("A", "4 (8.0)"), HEAD, "N=50", "Values were rounded")), [("rounding_ambiguous", "source_rounding_convention_not_modeled", 50, "table_caption_or_footnote", None)]),
    "adjusted": (article(table(tr("A", "4 (8.0)"), HEAD, "N=50"), text="<p>Weighted percentages are reported.</p>"), [("scope_ambiguous", "adjustment_method_scope_not_mapped", None, None, None)]),
    "adjusted_elsewhere": (
        article(table(tr("A", "4 (8.0)"), HEAD, "N=50"), table(tr("A", "4 (8.0)"), HEAD, "N=50", ident="T2"), text='<p>Weighted percentages are shown only in <xref ref-type="table" rid="T2">Table 2</xref>.</p>'),
        [("arithmetic_match", None, 50, "table_caption_or_footnote", "8.0"), ("scope_ambiguous", "adjustment_method_scope_not_mapped", None, None, None)],
    ),
    "fragments": (article(table(tr("A", "P12 5 (10%); C4 10 (20%)".replace("P12", "P").replace("C4", "C")), HEAD, "N=50")), [("arithmetic_match", None, 50, "table_caption_or_footnote", "20"), ("arithmetic_match", None, 50, "table_caption_or_footnote", "10")]),
    "spans": (article(table("<tr><td>A</td><td rowspan='2'>4 (8.0)</td></tr><tr><td>B</td></tr>", HEAD, "N=50")), [("scope_ambiguous", "unsupported_data_cell_spans", None, None, None)]),
}


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "doc_id string, content binary")
    rows = percent_tables.relations(articles.layouts(df)).orderBy("doc_id", "relation_ix").collect()
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, []).append(r)
    return out


@pytest.mark.parametrize("name", CASES)
def test_relations(found, name):
    got = [(r.status, r.reason, r.denominator, r.denominator_scope, r.expected_percent) for r in found.get(name, [])]
    assert got == CASES[name][1]


def test_evidence_slices_the_cell(found):
    data = CASES["caption"][0]
    e = found["caption"][0].evidence
    assert data[e.byte_start : e.byte_end] == b"<td>4 (8.00)</td>"


def test_refusals(spark):
    bad = {
        "empty": b"", "nul": b"<article>\x00</article>", "utf16": b"\xff\xfe<", "doctype": b"<!DOCTYPE article><article/>", "root": b"<book/>", "open": b"<article>",
        "deep": b"<article>" + b"<p>" * 300 + b"</p>" * 300 + b"</article>", "ok": b"<article/>",
    }
    df = spark.createDataFrame(list(bad.items()), "doc_id string, content binary")
    got = {r.doc_id: (r.status, r.reason) for r in percent_tables.document_status(articles.layouts(df)).collect()}
    assert got == {
        "empty": ("refused", "empty"), "nul": ("refused", "not_utf8"), "utf16": ("refused", "not_utf8"), "doctype": ("refused", "declarations_not_accepted"),
        "root": ("refused", "root_is_not_article"), "open": ("refused", "malformed_xml"), "deep": ("refused", "too_deep"), "ok": ("parsed", None),
    }


def test_nodes_have_byte_spans_and_paths(spark):
    data = '<article><body><p>é <b>x</b></p><p a="1>2"/></body></article>'.encode()
    df = spark.createDataFrame([("d", data)], "doc_id string, content binary")
    rows = articles.exploded(articles.nodes(df), "nodes").orderBy("node_id").collect()
    assert [r.path for r in rows] == ["/article[1]", "/article[1]/body[1]", "/article[1]/body[1]/p[1]", "/article[1]/body[1]/p[1]/b[1]", "/article[1]/body[1]/p[2]"]
    assert data[rows[2].byte_start : rows[2].byte_end].decode() == "<p>é <b>x</b></p>"
    assert data[rows[4].byte_start : rows[4].byte_end] == b'<p a="1>2"/>'
    assert rows[2].text == "é x"


def test_documents_with_too_many_relations_are_refused_with_a_reason(spark):
    many = lambda n: article(table("".join(tr("r", f"{i} (1.0)") for i in range(1, n + 1)), HEAD, "N=9999"))
    docs = articles.layouts(spark.createDataFrame([("at", many(1000)), ("above", many(1001))], "doc_id string, content binary"))
    assert {r.doc_id: (r.status, r.reason) for r in percent_tables.document_status(docs).collect()} == {"at": ("parsed", None), "above": ("refused", "too_many_relations")}
    assert {r.doc_id for r in percent_tables.relations(docs).select("doc_id").distinct().collect()} == {"at"}


def test_grids_with_spans_and_clashes(spark):
    """Cells that reach over rows and columns against a plain grid of slots."""
    import random

    rng = random.Random(2)
    for _ in range(60):
        rows = [[(rng.choice([1, 1, 2, 3]), rng.choice([1, 1, 2])) for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 4))]
        body = "".join("<tr>" + "".join(f'<td colspan="{a}" rowspan="{d}">x</td>' for a, d in r) + "</tr>" for r in rows)
        doc = articles.parse(f"<article><table>{body}</table></article>".encode())
        grid = articles.Grid(doc, [doc.kids(r, "td") for r in doc.find(0, "tr")])
        taken, want, bad = set(), [], False
        for r, cells in enumerate(rows):
            c = 0
            for a, d in cells:
                while (r, c) in taken:
                    c += 1
                if r + d > len(rows):
                    a = d = 1
                    bad = True
                slots = {(i, j) for i in range(r, r + d) for j in range(c, c + a)}
                bad = bad or bool(slots & taken)
                taken |= slots
                want.append((r, c, a, d))
                c += a
        assert [(r, c, a, d) for _, r, _, c, a, d in grid.rects] == want and grid.bad == bad
        if not bad:
            assert grid.full() == (len(taken) == len(rows) * (max(j for _, j in taken) + 1))


def test_hostile_articles_take_linear_time(spark):
    import time

    began = time.process_time()
    wide = articles.parse(b"<article>" + b"<p a='>'/>" * 90_000 + b"</article>")
    assert len(articles.node_rows(wide)) == 90_001 and time.process_time() - began < 20
    assert [r["ordinal"] for r in articles.node_rows(wide)[:4]] == [0, 0, 1, 2]
