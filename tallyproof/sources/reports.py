"""Reports on one document's relations, as escaped HTML and Markdown columns; rows are put in order before they are joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("relation_ix", "table_id", "status", "reason", "numerator", "denominator", "reported_percent", "expected_percent")


def escaped(c: Column) -> Column:
    """Text safe in HTML text and attributes."""
    c = F.coalesce(c.cast("string"), F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def plain(c: Column) -> Column:
    """Text safe in a Markdown table: one line, no bars, no markup signs."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s+", " "), r"([\\|`*_\[\]<>#])", r"\\$1")


def rendered(relations: DataFrame, cell, left: str, right: str, between: str) -> DataFrame:
    row = F.concat(F.lit(left), F.concat_ws(between, *(cell(F.col(c)) for c in COLUMNS)), F.lit(right))
    rows = relations.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("relation_ix", row.alias("row")))).alias("rows"))
    return rows.select("doc_id", F.array_join(F.transform("rows", lambda r: r["row"]), "").alias("rows"))


def html(relations: DataFrame) -> DataFrame:
    """(doc_id, html) with one table of the document's relations."""
    rows = rendered(relations, escaped, "<tr><td>", "</td></tr>", "</td><td>")
    head = "".join(f"<th>{c}</th>" for c in COLUMNS)
    page = F.concat(F.lit("<!DOCTYPE html><html><head><meta charset='utf-8'><title>"), escaped(F.col("doc_id")), F.lit(f"</title></head><body><p>Candidates are unreviewed.</p><table><tr>{head}</tr>"), F.col("rows"), F.lit("</table></body></html>"))
    return rows.select("doc_id", page.alias("html"))


def markdown(relations: DataFrame) -> DataFrame:
    rows = rendered(relations, plain, "| ", " |\n", " | ")
    head = f"| {' | '.join(COLUMNS)} |\n|{'---|' * len(COLUMNS)}\n"
    return rows.select("doc_id", F.concat(F.lit("# "), plain(F.col("doc_id")), F.lit("\n\nCandidates are unreviewed.\n\n" + head), F.col("rows")).alias("markdown"))
