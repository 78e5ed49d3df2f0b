"""Checks over table cells besides the percentage detector: totals, section denominators, fact traces, layout text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyproof.functions import exact
from tallyproof.operators.percent_tables import ADJUSTED, INT, PAIR, ROUNDING, facts, like, number

# What a caption has to say, and words that make its scope unclear.
PARTITION = r"(?iu)\b(?:mutually exclusive and exhaustive categories of participants)\b"
UNSAFE = (
    r"(?iu)\b(?:not mutually|not exhaustive|overlap(?:ping)?|multiple responses?|weighted|adjusted|imputed|estimated|subsample|subset|available cases?|"
    r"missing(?:ness)?|unknown|unreported|exclud(?:e|ed|ing)|non-exhaustive|nonexclusive|non-exclusive)\b"
)
PEOPLE = ("participants", "number of participants", "participants (n)")
SECTION_N = rf"(?U)^\s*(?:\(?\s*[nN]\s*=\s*)?({INT})\s*\)?\s*$"
SECTION_LABEL = r"(?iu)^\s*(?:n(?:umber)?|no\.?)\s*(?:of)?\s*(?:participants|patients|subjects|analy[sz]ed|included)?.*\b(?:participants|patients|subjects|analy[sz]ed|population)\b.*$"
ROW_CUE = r"(?iu)\bn\s*\(\s*%\s*\)|\bn\s*,\s*%"


def rows_of(tables: DataFrame, *keep: str) -> DataFrame:
    """Body rows with their cells in order."""
    cells = tables.select("doc_id", "table_index", *keep, F.explode(F.filter("cells", lambda c: c["section"] == "body")).alias("c"))
    rows = cells.groupBy("doc_id", "table_index", *keep, F.col("c.row").alias("row"))
    return rows.agg(F.array_sort(F.collect_list(F.struct("c.cell", "c.col", "c.text", "c.colspan", "c.rowspan", "c.headers", "c.byte_start", "c.byte_end"))).alias("cells"))


def count_totals(tables: DataFrame) -> DataFrame:
    """Categories of participants against the stated total of a two-column table whose caption says that they are all and apart."""
    heads = F.transform(F.array_sort(F.filter("cells", lambda c: c["section"] == "head"), lambda a, b: a["col"] - b["col"]), lambda c: c["text"])
    t = tables.withColumn("heads", heads)
    applies = (F.lower(F.get("heads", F.lit(0))) == "category") & F.lower(F.get("heads", F.lit(1))).isin(*PEOPLE)
    t = t.withColumn("applies", F.coalesce(applies, F.lit(False)))
    r = rows_of(t, "table_id", "label", "caption", "foots", "header_bad", "body_bad", "heads", "applies").withColumnRenamed("label", "table_label").withColumns({
        "label": F.lower(F.trim(F.get("cells", F.lit(0))["text"])), "n": number(F.regexp_extract(F.get("cells", F.lit(1))["text"], rf"^\s*({INT})\s*$", 1)),
        "two": F.size("cells") == 2, "plain": F.forall("cells", lambda c: (c["colspan"] == 1) & (c["rowspan"] == 1)),
    })
    last = Window.partitionBy("doc_id", "table_index")
    r = r.withColumn("is_last", F.col("row") == F.max("row").over(last))
    g = r.groupBy("doc_id", "table_index", "table_id", "table_label", "caption", "foots", "header_bad", "body_bad", "heads", "applies").agg(
        F.count("*").alias("rows"), F.bool_and("two").alias("two"), F.bool_and("plain").alias("plain"), F.bool_and(F.col("n").isNotNull() & (F.col("label") != "") & ~like(F.col("label"), UNSAFE)).alias("sound"),
        F.countDistinct("label").alias("labels"), F.sum(F.when(~F.col("is_last"), F.col("n"))).alias("computed"), F.max(F.when(F.col("is_last"), F.col("n"))).alias("stated"),
        F.max(F.when(F.col("is_last"), F.col("label"))).alias("last_label"), F.count_if(F.col("label") == "total").alias("total_rows"),
    )
    caption = F.coalesce("caption", F.lit(""))
    reason = (
        F.when(~like(caption, PARTITION), "EXHAUSTIVE_DISJOINT_SOURCE_DECLARATION_MISSING")
        .when(like(F.concat_ws(" ", caption, "table_label"), UNSAFE), "SOURCE_SCOPE_CONFLICT")
        .when((F.size("heads") != 2) | (F.size("foots") > 0) | F.col("header_bad") | F.col("body_bad"), "UNRESOLVED_TABLE_STRUCTURE_OR_FOOTNOTES")
        .when(~F.col("rows").between(3, 64), "TOTAL_ROW_OR_GROUP_STRUCTURE_AMBIGUOUS")
        .when(~F.col("two"), "COUNT_COLUMN_LAYOUT_AMBIGUOUS")
        .when(~F.col("plain"), "COUNT_CELL_SCOPE_OR_ANCHOR_UNRESOLVED")
        .when(~F.col("sound") | (F.col("labels") != F.col("rows")), "COUNT_OPERAND_OR_CATEGORY_INVALID")
        .when((F.col("last_label") != "total") | (F.col("total_rows") != 1), "FINAL_UNIQUE_TOTAL_ROW_REQUIRED")
        .when(F.col("computed") > exact.MAX_COUNT, "COUNT_SUM_OUT_OF_DOMAIN")
    )
    g = g.withColumn("reason", F.when(F.col("applies"), reason))
    status = F.when(~F.col("applies"), "NOT_APPLICABLE").when(F.col("reason").isNotNull(), "UNSUPPORTED").when(F.col("computed") == F.col("stated"), "COUNT_TOTAL_MATCH").otherwise("COUNT_TOTAL_MISMATCH_CANDIDATE")
    free = F.col("applies") & F.col("reason").isNull()
    return g.select("doc_id", "table_id", status.alias("status"), "reason", F.when(free, F.col("computed")).alias("computed_total"), F.when(free, F.col("stated")).alias("stated_total"), F.when(free, F.col("stated") - F.col("computed")).alias("difference"))


def section_proposals(tables: DataFrame) -> DataFrame:
    """Denominators that a section row prints for each column, as hypotheses for the rows below it."""
    around = F.array_join(F.concat(F.array(F.coalesce("caption", F.lit(""))), "foots"), " ")
    rows = rows_of(tables.where(~F.col("body_bad") & ~F.col("header_bad")).withColumn("blocked", like(around, ADJUSTED) | like(around, ROUNDING)), "table_id", "blocked")
    first = F.get("cells", F.lit(0))["text"]
    rest = F.slice("cells", 2, 256)
    ns = F.transform(rest, lambda c: number(F.regexp_extract(c["text"], SECTION_N, 1)))
    marker = like(first, SECTION_LABEL) & (F.size("cells") > 1) & F.forall(ns, lambda n: F.coalesce(n > 0, F.lit(False)))
    edge = marker | like(first, SECTION_LABEL) | (F.size(F.filter(ns, lambda n: n.isNotNull())) >= 2)
    upto = Window.partitionBy("doc_id", "table_index").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"edge": edge, "marker": marker, "ns": ns, "first": first, "width": F.size("cells")})
    held = F.struct("row", "marker", "ns", "width", F.col("first").alias("label"))
    rows = rows.withColumn("section", F.last(F.when(F.col("edge"), held), True).over(upto))
    rows = rows.where(~F.col("edge") & F.col("section.marker") & (F.col("width") == F.col("section.width")) & ~F.col("blocked") & like(F.col("first"), ROW_CUE))
    cells = rows.select("doc_id", "table_id", "table_index", "row", "first", "section", F.posexplode(F.slice("cells", 2, 256)).alias("k", "c")).where(like(F.col("c.text"), PAIR))
    n, shown, d = number(F.regexp_extract("c.text", PAIR, 1)), F.regexp_extract("c.text", PAIR, 2), F.get("section.ns", F.col("k"))
    p = exact.decimals_of(shown)
    units = exact.percent_units(n, d, p)
    known = exact.in_domain(n, d, p)
    header = F.array_distinct(F.flatten(F.transform("c.headers", facts)))
    return cells.where(known).select(
        "doc_id", "table_id", F.col("section.label").alias("section_label"), F.col("first").alias("row_label"), n.alias("numerator"), d.alias("proposed_denominator"), shown.alias("reported_percent"),
        exact.print_units(units, p).alias("expected_percent"), F.when(units == exact.scaled(shown), "conditional_match").otherwise("conditional_mismatch").alias("status"),
        ((F.size(header) > 0) & (header != F.array(d))).alias("conflicting_header"), F.col("c.byte_start"), F.col("c.byte_end"),
    )


def denominator_facts(tables: DataFrame) -> DataFrame:
    """Every printed n = .. of a table with its role."""
    texts = F.flatten(F.array(
        F.array(F.struct(F.lit("table_label").alias("role"), F.col("label").alias("text")), F.struct(F.lit("table_caption").alias("role"), F.col("caption").alias("text"))),
        F.transform("foots", lambda t: F.struct(F.lit("table_footnote").alias("role"), t.alias("text"))),
        F.transform("cells", lambda c: F.struct(F.when(c["section"] == "head", F.lit("column_header")).otherwise(F.lit("row_context")).alias("role"), c["text"].alias("text"))),
    ))
    rows = tables.select("doc_id", "table_index", F.explode(texts).alias("x"))
    return rows.select("doc_id", "table_index", "x.role", F.explode(facts(F.col("x.text"))).alias("value"), F.col("x.text").alias("quote"))


def denominator_trace(relations: DataFrame, tables: DataFrame) -> DataFrame:
    """Relations with the facts of their table: how many, which roles, and whether they disagree."""
    f = denominator_facts(tables).groupBy("doc_id", "table_index").agg(
        F.count("*").alias("facts"), F.array_sort(F.collect_set("role")).alias("roles"), F.countDistinct("value").alias("values"), F.collect_set("value").alias("all_values")
    )
    rows = relations.join(f, ["doc_id", "table_index"], "left")
    return rows.withColumn("conflicting_facts", F.coalesce(F.col("values") > 1, F.lit(False))).withColumn(
        "denominator_is_printed", F.coalesce(F.array_contains("all_values", F.col("denominator")), F.lit(False))
    )


def layout_lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, page, line, start, text) of layout text; pages end with a form feed; start counts code points."""
    lines = df.select(F.col(key).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("line", "raw"))
    upto = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    feeds = F.length("raw") - F.length(F.replace("raw", F.lit("\f"), F.lit("")))
    rows = lines.withColumn("start", F.coalesce(F.sum(F.length("raw") + 1).over(upto), F.lit(0))).withColumn("page", F.coalesce(F.sum(feeds).over(upto), F.lit(0)) + F.when(F.startswith("raw", F.lit("\f")), 1).otherwise(0) + 1)
    return rows.select("doc_id", "page", (F.col("line") + 1).alias("line"), "start", F.replace("raw", F.lit("\f"), F.lit("")).alias("text"))


def layout_relations(lines: DataFrame, header_lines: int = 8) -> DataFrame:
    """Counts and percentages of tables in layout text; the header's N holds for a table's rows."""
    title = like(F.col("text"), r"(?iu)^\s*table\s+[0-9A-Z]+") | like(F.col("text"), r"(?iu)count\s*\(\s*%\s*\).*n\s*=")
    upto = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("table", F.sum(F.when(title, 1).otherwise(0)).over(upto)).where("table > 0")
    table = Window.partitionBy("doc_id", "table")
    rows = rows.withColumn("offset", F.row_number().over(table.orderBy("line")) - 1)
    operand = rf"(?U)^\s*(\S.*?)\s+({INT})\s*\(\s*([0-9]{{1,3}}(?:\.[0-9]{{1,6}})?)\s*%?\s*\)\s*$"
    rows = rows.withColumn("is_row", like(F.col("text"), operand))
    # The header ends where the first row begins, at most header_lines below the title.
    rows = rows.withColumn("first_row", F.min(F.when(F.col("is_row"), F.col("offset"))).over(table))
    in_head = F.col("offset") < F.least(F.col("first_row"), F.lit(header_lines))
    head = rows.where(in_head).groupBy("doc_id", "table").agg(F.array_distinct(F.flatten(F.collect_list(facts(F.col("text"))))).alias("ns"), F.bool_or(like(F.col("text"), r"%|(?iu)percent")).alias("said"), F.bool_or(like(F.col("text"), ADJUSTED)).alias("adjusted"), F.bool_or(like(F.col("text"), ROUNDING)).alias("rounding"))
    found = rows.where("is_row").join(head, ["doc_id", "table"], "left")
    n, shown = number(F.regexp_extract("text", operand, 2)), F.regexp_extract("text", operand, 3)
    d = F.when(F.size("ns") == 1, F.get("ns", F.lit(0)))
    p = exact.decimals_of(shown)
    units = exact.percent_units(n, d, p)
    match = F.coalesce(units == exact.scaled(shown), F.lit(False))
    confirmed = F.coalesce("said", F.lit(False)) | ((F.count_if(match).over(table) >= 2) & (F.count_if(match).over(table) * 2 >= F.count("*").over(table)))
    reason = (
        F.when(F.size("ns") > 1, "conflicting_column_denominators")
        .when(F.coalesce(F.size("ns") == 0, F.lit(True)), "no_explicit_denominator")
        .when(d <= 0, "nonpositive_denominator")
        .when(F.col("adjusted"), "adjustment_method_scope_not_mapped")
        .when(~confirmed, "percentage_context_not_explicit")
        .when(F.col("rounding"), "source_rounding_convention_not_modeled")
        .when(~exact.in_domain(n, d, p), "invalid_or_unsupported_ratio")
    )
    status = F.when(reason == "source_rounding_convention_not_modeled", "rounding_ambiguous").when(reason.isNotNull(), "scope_ambiguous").when(match, "arithmetic_match").otherwise("arithmetic_mismatch_candidate")
    return found.select("doc_id", "page", "line", "table", F.regexp_extract("text", operand, 1).alias("label"), n.alias("numerator"), d.alias("denominator"), shown.alias("reported_percent"), reason.alias("reason"), status.alias("status"))
