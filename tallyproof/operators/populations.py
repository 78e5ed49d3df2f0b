"""Group sizes that an article states outside its tables, as conditional denominators.

"... intervention group (n=41)" is no denominator of a table: allocation may differ from analysis.
A relation that has none of its own and whose headers, or caption where the headers are generic,
name exactly one such group gets the value it would have; its verdict stays an abstention.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyproof.functions import exact
from tallyproof.operators.percent_tables import INT, number
from tallyproof.sources import articles

# How a group's size is stated, words that say nothing or turn a label round, headers that name no group.
STATED = rf"(?iu)((?:[A-Za-z][A-Za-z0-9'’_-]*\s+){{0,3}}(?:group|arm))\s*\(\s*n\s*[=:]\s*({INT})\s*\)"
SILENT = ("a", "an", "and", "for", "in", "of", "the", "to")
NEGATORS = ("anti", "never", "no", "non", "not", "unlike", "without")
GENERIC = (
    "arm arms category categories characteristic characteristics count counts frequency frequencies measure measures n no number numbers outcome outcomes "
    "parameter parameters participant participants patient patients percent percentage percentages response responses subject subjects value values variable variables"
).split()
#: A document that states more groups than this gives none.
MAX_STATED = 64


def words(text: Column) -> Column:
    found = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin(*SILENT))
    return F.transform(found, lambda w: F.when(w == "interventional", F.lit("intervention")).otherwise(w))


def occurs(label: Column, said: Column) -> Column:
    """Is the label a run of the words, without a negator among the three words before it."""
    n = F.size(label)

    def at(i: Column) -> Column:
        before = F.slice(said, F.greatest(i - 3, F.lit(0)) + 1, F.least(i, F.lit(3)))
        return (F.slice(said, i + 1, n) == label) & ~F.arrays_overlap(before, F.array(*map(F.lit, NEGATORS)))

    places = F.when(F.size(said) >= n, F.sequence(F.lit(0), F.size(said) - n)).otherwise(F.array().cast("array<int>"))
    return (n > 0) & F.exists(places, at)


def stated(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, label, n) of the sizes stated in a document's text; label is an array of words."""
    rows = paragraphs.where("not in_table and in_body").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(STATED), F.lit(0))).alias("x"))
    rows = rows.select("doc_id", words(F.regexp_extract("x", STATED, 1)).alias("label"), number(F.regexp_extract("x", STATED, 2)).alias("n"))
    few = rows.groupBy("doc_id").agg(F.count("*").alias("all")).where(F.col("all") <= MAX_STATED).select("doc_id")
    return rows.join(few, "doc_id").where(F.exists("label", lambda w: ~w.isin("group", "arm")))


def conditional_values(relations: DataFrame, parsed: DataFrame) -> DataFrame:
    """(doc_id, relation_ix, label, conditional_denominator, rounded_percent, matches, conflicting) of relations without a denominator."""
    groups = stated(articles.exploded(parsed, "paragraphs"))
    tables = articles.exploded(parsed, "tables").select("doc_id", "table_index", F.array("label", "caption").alias("around"))
    rows = relations.where("reason = 'no_explicit_denominator'").join(tables, ["doc_id", "table_index"])
    rows = rows.select("doc_id", "relation_ix", "numerator", "reported_percent", F.col("evidence.column_headers").alias("heads"), "around")
    both = rows.join(groups, "doc_id")
    hit = lambda texts: F.exists(texts, lambda t: occurs(F.col("label"), words(t)))
    generic = F.forall(F.flatten(F.transform("heads", words)), lambda w: w.isin(*GENERIC))
    both = both.withColumns({"in_heads": hit("heads"), "in_caption": generic & hit("around")})
    keys = ("doc_id", "relation_ix", "numerator", "reported_percent")
    g = both.groupBy(*keys).agg(*(F.collect_set(F.when(F.col(c), F.struct("label", "n"))).alias(c) for c in ("in_heads", "in_caption")))
    found = F.when(F.size("in_heads") > 0, F.col("in_heads")).otherwise(F.col("in_caption"))
    g = g.withColumn("found", found).withColumn("labels", F.array_distinct(F.transform("found", lambda x: x["label"]))).where(F.size("labels") == 1)
    g = g.withColumn("ns", F.array_distinct(F.transform("found", lambda x: x["n"])))
    d, p = F.when(F.size("ns") == 1, F.get("ns", F.lit(0))), exact.decimals_of(F.col("reported_percent"))
    units = F.when(exact.in_domain("numerator", d, p), exact.percent_units("numerator", d, p))
    return g.select(
        "doc_id", "relation_ix", F.array_join(F.get("labels", F.lit(0)), " ").alias("label"), d.alias("conditional_denominator"), exact.print_units(units, p).alias("rounded_percent"),
        (units == exact.scaled(F.col("reported_percent"))).alias("matches"), (F.size("ns") > 1).alias("conflicting"),
    )
