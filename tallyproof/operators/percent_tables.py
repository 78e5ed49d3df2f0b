"""Counts and percentages in article tables: facts, operands, scope of the denominator, verdict.

All of it is columns over the cells of sources.articles.layouts(): windows carry group markers and
poison groups with missing-data rows, patterns read facts and operands, lattice.scope() picks the
denominator, exact arithmetic gives the verdict. Patterns start with (?Uiu) where case and white
space follow Unicode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyproof.functions import exact
from tallyproof.operators import lattice
from tallyproof.sources import articles

# The grammar of printed counts, percentages and their contexts.
INT = r"(?:[0-9]{1,3}(?:,[0-9]{3}){1,2}|[0-9]{1,9})"
PCT = r"[0-9]{1,3}(?:\.[0-9]{1,6})?"
PAIR = rf"(?U)^\s*({INT})\s*\(\s*({PCT})\s*(%?)\s*\)\s*$"
RATIO = rf"(?U)^\s*({INT})\s*/\s*({INT})\s*\(\s*({PCT})\s*(%?)\s*\)\s*(?:[*#†‡]+)?\s*$"
PCT_ONLY = rf"(?U)^\s*({PCT})\s*%?\s*$"
COUNT_ONLY = rf"(?U)^\s*({INT})\s*$"
FACT = rf"(?U)(?<![A-Za-z0-9])[nN]\s*[=:]\s*({INT})(?![0-9]|[,.][0-9])"
COMPONENT = rf"([A-Za-z][A-Za-z _:.-]{{0,39}}?)\s*({INT}\s*\(\s*{PCT}\s*%\s*\))"
CONTEXT = r"(?Uiu)\bn\s*\(\s*%|\(\s*%\s*\)|\bpercent(?:age)?s?\b"
BASIS = r"(?Uiu)\bpercent(?:age)?s?\b.{0,100}\b(?:denominator|based on|full cohort|entire cohort)\b|\b(?:denominator|full cohort|entire cohort)\b.{0,100}\bpercent(?:age)?s?\b|\bof\s+(?:the\s+)?(?:total|all)\s+[A-Za-z][A-Za-z0-9 /_-]{0,80}\(\s*%\s*\)"
TOTAL_ROW = rf"(?Uiu)^\s*(?:(?:grand|overall)\s+)?total\s*[:=\-]?\s*({INT})\s*\(\s*100(?:\.0+)?\s*%\s*\)\s*$"
GROUP_PCT = r"(?Uiu)\bn\s*\(\s*%"
ROW_RATIO = r"(?Uiu)\bn\s*\(\s*%\s*[^)]*\bn\s*/\s*n\b"
ROUNDING = r"(?Uiu)\b(?:rounded|rounding|round\s+(?:to|up|down|off|(?:all\s+)?percent(?:age)?s?)|truncat(?:e|ed|ion))\b"
SPREAD = r"(?Uiu)\b(?:mean|median|SD|IQR|standard deviation)\b"
MISSING = r"(?Uiu)^(?:missing|unknown|not available|not reported|not known)\b"
ADJUSTED = r"(?Uiu)\b(?:adjusted|weighted|standardized|standardised)\b.{0,120}\b(?:percent(?:age)?s?|frequenc(?:y|ies)|proportions?|rates?)\b|\b(?:percent(?:age)?s?|frequenc(?:y|ies)|proportions?|rates?)\b.{0,120}\b(?:adjusted|weighted|standardized|standardised)\b"
TOTALS = r"(?Uiu)\b(?:no\.? of patients|number of patients|total(?: patients| participants| population)?|all participants)\b"
COUNT_HEAD = r"^n$|(?Uiu)^(?:no|no\.|frequency|frequencies)$|(?Uiu)\b(?:count|number|frequency)\b|(?Uiu)^N\s*(?:\(\s*(?:count|numerator|frequency)\s*\)|[,:\-]\s*(?:count|numerator|frequency))$|(?Uiu)^N\s+of\s+(?:patients|participants|subjects|cases|admissions|respondents)$"
N_HEAD = r"^N$|(?Uiu)^(?:denominator|total\s+N)$"
PCT_HEAD = r"(?Uiu)%|percent(?:age)?"
#: Documents beyond these are refused.
MAX_RESULTS, MAX_COMPONENTS, MAX_QUOTE = 1_000, 8, 500


def number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("bigint")


def printed_pairs(text: Column) -> Column:
    """Array of (hit, numerator, reported_percent) of all n (p) in running text."""
    hits = F.regexp_extract_all(text, F.lit(r"[0-9]{1,9} ?\([0-9]{1,3}(\.[0-9]{1,6})?%?\)"), F.lit(0))
    return F.transform(hits, lambda x: F.struct(x.alias("hit"), F.regexp_extract(x, "^([0-9]+)", 1).cast("bigint").alias("numerator"), F.regexp_extract(x, r"\(([0-9.]+)", 1).alias("reported_percent")))


def facts(text: Column) -> Column:
    """Values of all n = .. in a text."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(FACT), F.lit(1)), number)


def facts_of(texts: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(texts, facts)))


def like(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(pattern)), F.lit(False))


def any_like(texts: Column, pattern: str) -> Column:
    return F.coalesce(F.exists(texts, lambda t: like(t, pattern)), F.lit(False))


def numeric(text: Column) -> Column:
    return like(text, PAIR) | like(text, RATIO) | like(text, PCT_ONLY)


def fragments(text: Column) -> Column:
    """Labelled parts of a cell as (label, quote), or one with null label for the cell as it is."""
    found = F.regexp_extract_all(text, F.lit(COMPONENT), F.lit(0))
    parts = F.transform(found, lambda x: F.struct(F.trim(F.regexp_extract(x, COMPONENT, 1)).alias("label"), F.regexp_extract(x, COMPONENT, 2).alias("quote")))
    only = F.regexp_like(F.regexp_replace(text, COMPONENT, ""), F.lit(r"^[ ;,|\t\r\n]*$"))
    labels = F.transform(parts, lambda x: x["label"])
    ok = F.size(found).between(2, MAX_COMPONENTS) & only & (F.size(F.array_distinct(labels)) == F.size(labels))
    return F.when(ok, parts).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("label"), text.alias("quote"))))


def table_flags(tables: DataFrame, notes: DataFrame) -> DataFrame:
    """Of each table: the contexts that hold for all its cells."""
    heads = F.transform(F.filter("cells", lambda c: c["section"] == "head"), lambda c: c["text"])
    every = F.transform("cells", lambda c: c["text"])
    around = F.array_compact(F.concat(F.array("label", "caption"), "foots"))
    width = F.aggregate(F.filter("cells", lambda c: c["section"] == "head"), F.lit(0), lambda a, c: F.greatest(a, c["col"] + c["colspan"]))
    full = F.filter("cells", lambda c: (c["section"] == "body") & (c["colspan"] == F.col("width")) & (c["cell"] == 0) & like(c["text"], TOTAL_ROW))
    rows = tables.withColumns({"heads": heads, "every": every, "around": around, "width": width})
    context = F.concat_ws(" ", F.concat("around", "heads"))
    rows = rows.withColumns({
        "context": context,
        "pct_context": like(context, CONTEXT) | F.exists("heads", lambda t: F.trim(t) == "%"),
        "basis": like(context, BASIS),
        "rounding": like(F.concat_ws(" ", F.array(context), "every"), ROUNDING),
        "own_notes": any_like(F.concat("around", "every"), ADJUSTED),
        "caption_ns": facts_of(F.col("around")),
        "total_ns": facts_of(F.filter("heads", lambda t: like(t, TOTALS))),
        "totals": F.when(F.size("heads") > 0, full).otherwise(F.filter("cells", lambda c: F.lit(False))),
    })
    one_total = F.col("basis") & F.col("pct_context") & (F.size("totals") == 1)
    rows = rows.withColumn("total_row", F.when(one_total, F.get("totals", F.lit(0))["row"]))
    total_n = F.when(one_total, number(F.regexp_extract(F.get("totals", F.lit(0))["text"], TOTAL_ROW, 1)))
    rows = rows.withColumn("total_n", total_n).withColumn("global_ns", F.array_distinct(F.array_compact(F.concat("caption_ns", F.array("total_n")))))
    rows = rows.join(notes, "doc_id", "left").withColumn(
        "adjusted",
        F.col("own_notes") | F.coalesce(F.exists("notes", lambda n: n["target"].isNull() | (n["target"] == F.col("table_id"))), F.lit(False)),
    )
    return rows


def method_notes(paragraphs: DataFrame) -> DataFrame:
    """Of each document: adjustment notes outside tables; the target is a table only where one sentence names just it."""
    said = r"(?iu)^(?:The\s+)?(?:weighted|adjusted|standardized|standardised)\s+percentages?\s+(?:appear|are\s+(?:shown|reported|presented|used))\s+(?:only\s+)?in\s+\Q"
    narrow = (F.size("rids") == 1) & F.regexp_like("text", F.concat(F.lit(said), F.col("ref_text"), F.lit(r"\E\s*[.]?$")))
    rows = paragraphs.where(~F.col("in_table") & F.regexp_like("text", F.lit(ADJUSTED)))
    return rows.groupBy("doc_id").agg(F.collect_list(F.struct(F.when(narrow, F.get("rids", F.lit(0))).alias("target"))).alias("notes"))


def body_cells(flags: DataFrame) -> DataFrame:
    """Body cells with their row's context: marker rows carried forward, missing-data rows, neighbours to the left."""
    keep = ["doc_id", "table_index", "table_id", "context", "pct_context", "basis", "rounding", "adjusted", "global_ns", "total_ns", "total_row", "header_bad", "body_bad"]
    cells = flags.select(*keep, F.explode(F.filter("cells", lambda c: c["section"] == "body")).alias("c")).select(*keep, "c.*")
    cells = cells.where(F.col("total_row").isNull() | (F.col("row") != F.col("total_row")))
    row = Window.partitionBy("doc_id", "table_index", "row")
    filled = F.count_if(F.col("text") != "").over(row)
    text = F.max(F.when(F.col("text") != "", F.col("text"))).over(row)
    wide = F.max(F.when(F.col("text") != "", F.col("colspan"))).over(row) > 1
    marker = (filled == 1) & ~numeric(text) & ((F.count("*").over(row) > 1) | wide | like(text, FACT) | like(text, GROUP_PCT))
    cells = cells.withColumns({"marker": marker, "row_text": text, "first": F.col("cell") == 0})
    upto = Window.partitionBy("doc_id", "table_index").orderBy("row", "cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumns({
        "group": F.sum(F.when(F.col("marker") & F.col("first"), 1).otherwise(0)).over(upto),
        "group_text": F.last(F.when(F.col("marker"), F.col("row_text")), True).over(upto),
        "missing_here": F.max(like(F.col("text"), MISSING)).over(row),
        "row_texts": F.collect_list(F.struct("cell", "text")).over(row),
    })
    left = Window.partitionBy("doc_id", "table_index", "row").orderBy("cell")
    cells = cells.withColumns({
        "prev": F.lag("text", 1).over(left), "prev2": F.lag("text", 2).over(left), "prev_heads": F.lag("headers", 1).over(left), "prev2_heads": F.lag("headers", 2).over(left),
        "prev_start": F.lag("byte_start", 1).over(left), "unspanned": F.max("colspan").over(left.rowsBetween(Window.unboundedPreceding, 0)) == 1,
    })
    counted = number(F.regexp_extract("text", rf"(?U)^\s*({INT})\s*(?:/[^()]+)?\s*\(", 1)) > 0
    columns = F.col("missing_here") & F.coalesce(counted | (like(F.concat_ws(" ", "headers"), PCT_HEAD) & any_like(F.col("prev_heads"), COUNT_HEAD) & (number(F.regexp_extract("prev", COUNT_ONLY, 1)) > 0)), F.lit(False))
    scope = Window.partitionBy("doc_id", "table_index", "group", "col")
    return cells.withColumn("missing_row", F.max(columns).over(scope)).where(~F.col("marker"))


def operands(cells: DataFrame) -> DataFrame:
    """One row a relation: numerator, printed percentage, its own denominator, and the headers that speak for it."""
    rows = cells.withColumn("part", F.explode(fragments(F.col("text")))).withColumn("quote", F.col("part.quote"))
    q = F.col("quote")
    ratio, pair = like(q, RATIO), like(q, PAIR)
    heads = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    alone = ~ratio & ~pair & like(F.col("text"), PCT_ONLY) & F.col("unspanned") & (F.col("cell") > 0) & like(F.concat_ws(" ", "headers"), PCT_HEAD)
    triple = alone & (F.col("cell") >= 2) & any_like(heads("prev2_heads"), COUNT_HEAD) & any_like(heads("prev_heads"), N_HEAD)
    double = alone & ~triple & any_like(heads("prev_heads"), COUNT_HEAD) & like(F.col("prev"), COUNT_ONLY)
    triple = triple & like(F.col("prev2"), COUNT_ONLY)
    get = lambda c, p, k: F.regexp_extract(c, p, k)
    count = F.when(ratio, get(q, RATIO, 1)).when(pair, get(q, PAIR, 1)).when(triple, get(F.col("prev2"), COUNT_ONLY, 1)).when(double, get(F.col("prev"), COUNT_ONLY, 1))
    shown = F.when(ratio, get(q, RATIO, 3)).when(pair, get(q, PAIR, 2)).when(triple | double, get(F.col("text"), PCT_ONLY, 1))
    sign = F.when(ratio, get(q, RATIO, 4) == "%").when(pair, get(q, PAIR, 3) == "%").otherwise(triple | double)
    all_heads = F.when(triple, F.concat(heads("prev2_heads"), heads("prev_heads"), heads("headers"))).when(double, F.concat(heads("prev_heads"), heads("headers"))).otherwise(heads("headers"))
    rows = rows.withColumns({
        "form": F.when(ratio, "ratio").when(pair, "pair").when(triple, "n_N_percent").when(double, "n_percent"),
        "numerator": number(count), "reported_percent": shown, "signed": F.coalesce(sign, F.lit(False)),
        "ratio_n": F.when(ratio, number(get(q, RATIO, 2))), "row_n": F.when(triple, number(get(F.col("prev"), COUNT_ONLY, 1))),
        "heads": all_heads,
    }).where(F.col("form").isNotNull())
    others = F.transform(F.filter("row_texts", lambda x: x["cell"] != F.col("cell")), lambda x: x["text"])
    rows = rows.withColumn("row_labels", F.concat(others, "inherited"))
    context = F.col("signed") | F.col("pct_context") | like(F.col("group_text"), CONTEXT) | like(F.concat_ws(" ", "heads"), CONTEXT) | F.exists("heads", lambda t: F.trim(t) == "%")
    rows = rows.withColumns({
        "type_ambiguous": ~context,
        "header_ns": facts_of(F.col("heads")), "row_ns": facts_of(F.col("row_labels")), "group_ns": F.array_distinct(facts(F.col("group_text"))),
        "row_specific": like(F.concat_ws(" ", "headers"), ROW_RATIO) | like(F.col("context"), ROW_RATIO) | like(F.col("group_text"), ROW_RATIO),
    })
    spread = like(F.concat_ws(" ", F.concat("heads", "row_labels")), SPREAD)
    silent = F.col("type_ambiguous") & ((F.col("form") != "pair") | (F.size("header_ns") == 0) | spread)
    own_spans = numeric(F.col("text")) & ((F.col("colspan") != 1) | (F.col("rowspan") != 1))
    return rows.where(~silent).withColumns({
        "row_n_missing": (F.col("form") == "n_N_percent") & F.col("row_n").isNull(),
        "bad_header": F.col("header_bad"), "bad_spans": F.col("body_bad") | own_spans | F.exists("inherited", numeric),
        "explicit_basis": F.col("basis"), "has_totals": F.size("total_ns") > 0, "from_total_row": F.col("total_row").isNotNull(),
    })


def verdicts(rows: DataFrame) -> DataFrame:
    """Status, reason and recomputed values of relations that lattice.scope() has been through."""
    p, n, d = exact.decimals_of(F.col("reported_percent")), F.col("numerator"), F.col("denominator")
    known = exact.in_domain(n, d, p) & (exact.scaled(F.col("reported_percent")) <= 100 * exact.power_of_ten(p))
    reason = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(d.isNull(), "no_explicit_denominator")
        .when(d <= 0, "nonpositive_denominator")
        .when(F.col("rounding"), "source_rounding_convention_not_modeled")
        .when(~known, "invalid_or_unsupported_ratio")
    )
    units = exact.percent_units(n, d, p)
    rows = rows.withColumn("why", reason).withColumn("denominator", F.when(d > 0, d))
    free = F.col("why").isNull()
    status = (
        F.when(F.col("why") == "source_rounding_convention_not_modeled", "rounding_ambiguous")
        .when(~free, "scope_ambiguous")
        .when(units == exact.scaled(F.col("reported_percent")), "arithmetic_match")
        .otherwise("arithmetic_mismatch_candidate")
    )
    return rows.withColumns({
        "status": status, "reason": F.col("why"), "expected_percent": F.when(free, exact.print_units(units, p)),
        "exact_ratio": F.when(free, exact.ratio_text(n, d)), "display_precision": p,
    })


def all_relations(parsed: DataFrame) -> DataFrame:
    """Verdicts of every document, each row with the number of its document's relations."""
    tables, paragraphs = articles.exploded(parsed, "tables"), articles.exploded(parsed, "paragraphs")
    rows = verdicts(lattice.scope(operands(body_cells(table_flags(tables, method_notes(paragraphs))))))
    return rows.withColumn("n_relations", F.count("*").over(Window.partitionBy("doc_id")))


def relations(parsed: DataFrame) -> DataFrame:
    """All count and percentage relations of articles.layouts(); document_status() refuses documents beyond MAX_RESULTS, which give none."""
    rows = all_relations(parsed)
    evidence = F.struct(
        "byte_start", "byte_end", F.substring("text", 1, MAX_QUOTE).alias("cell_quote"), (F.length("text") > MAX_QUOTE).alias("cell_quote_truncated"), F.col("heads").alias("column_headers"), F.col("part.label").alias("label")
    )
    rows = rows.where(F.col("n_relations") <= MAX_RESULTS)
    order = Window.partitionBy("doc_id").orderBy("table_index", "row", "cell", "part.label")
    return rows.select(
        "doc_id", F.row_number().over(order).alias("relation_ix"), "table_id", "table_index", (F.col("row") + 1).alias("row_index"), F.col("cell").alias("cell_index"),
        "status", "reason", "numerator", "denominator", F.when(F.col("denominator").isNotNull(), F.col("denominator_scope")).alias("denominator_scope"), "reported_percent", "expected_percent", "exact_ratio", "display_precision", evidence.alias("evidence"),
        F.lit("unreviewed").alias("review_state"), F.lit("not_established").alias("scientific_error_status"),
    )


def document_status(parsed: DataFrame) -> DataFrame:
    """doc_id, status and reason: those of the parse, and a refusal where a document has more relations than MAX_RESULTS."""
    many = all_relations(parsed).where(F.col("n_relations") > MAX_RESULTS).select("doc_id").distinct().withColumn("many", F.lit(True))
    both = parsed.select("doc_id", "status", "reason").join(many, "doc_id", "left")
    return both.select("doc_id", F.when(F.col("many"), "refused").otherwise(F.col("status")).alias("status"), F.when(F.col("many"), "too_many_relations").otherwise(F.col("reason")).alias("reason"))
