"""Standalone prose of article bodies, and what the numbers of table cells stand for. Columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyproof.operators.percent_tables import COUNT_HEAD, COUNT_ONLY, PAIR, PCT_ONLY, RATIO, any_like, like, number

# Elements that prose doesn't stand in, and content that makes a paragraph more than prose.
NOT_PROSE = (
    "front", "back", "abstract", "table-wrap", "table", "table-wrap-foot", "caption", "fig", "fig-group", "fn", "ref-list", "boxed-text", "supplementary-material", "disp-quote", "disp-formula",
    "verse-group", "list", "list-item", "def-list", "statement", "glossary", "p",
)
COMPLEX = ("xref", "inline-formula", "disp-formula", "graphic", "media", "table", "list", "fn", "p", "ext-link")
SPREAD = ("mean", "standard deviation", "sd", "confidence interval", "95% ci")
MAX_PARAGRAPHS = 2048


def tags_above(path: Column) -> Column:
    """Tags of an element's ancestors, from its path."""
    tags = F.split(F.regexp_replace(path, r"\[[0-9]+\]", ""), "/")
    return F.slice(tags, F.lit(2), F.greatest(F.size(tags) - 2, F.lit(0)))


def body_paragraphs(nodes: DataFrame) -> DataFrame:
    """Paragraphs in a body, of articles.exploded(nodes): status projected, excluded, or refused where a document has more than MAX_PARAGRAPHS.

    A paragraph is excluded for where it stands, for elements in it that aren't prose, or for no
    text. Ancestors come from paths; elements in it are found by the paths that lead to them.
    """
    from pyspark.sql import Window

    above = tags_above(F.col("path"))
    p = nodes.where(F.col("tag") == "p").withColumn("above", above).where(F.array_contains("above", "body"))
    # Each element that isn't prose marks the paragraphs that it stands in: prefixes of its path that end with one.
    ends = F.sequence(F.lit(2), F.size(F.split("path", "/")) - 1)
    prefixes = F.filter(F.transform(ends, lambda k: F.array_join(F.slice(F.split("path", "/"), F.lit(1), k), "/")), lambda x: F.regexp_like(x, F.lit(r"/p\[[0-9]+\]$")))
    marked = nodes.where(F.col("tag").isin(*COMPLEX) & F.regexp_like("path", F.lit(r"/p\[[0-9]+\]/"))).select("doc_id", F.explode(prefixes).alias("path")).distinct().withColumn("complex", F.lit(True))
    rows = p.join(marked, ["doc_id", "path"], "left")
    reason = (
        F.when(F.arrays_overlap("above", F.array(*map(F.lit, NOT_PROSE))), "stands_outside_prose").when(F.col("complex"), "holds_more_than_prose").when(F.col("text") == "", "empty")
    )
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("doc_id")))
    many = F.col("n") > MAX_PARAGRAPHS
    status = F.when(many, "refused").when(reason.isNotNull(), "excluded").otherwise("projected")
    return rows.select("doc_id", "path", "byte_start", "byte_end", F.when(status == "projected", F.col("text")).alias("text"), status.alias("status"), F.when(many, "body_paragraph_limit").otherwise(reason).alias("reason"))


def numeric_values(text: Column, headers: Column, conflicting: Column | bool = False) -> Column:
    """Array of (surface, exact, role, display_precision) of a cell's numbers; a role only where a sign or a heading gives it."""
    heading = F.lower(F.concat_ws(" ", headers))
    said = lambda *words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(heading, w))
    conflict = conflicting if isinstance(conflicting, Column) else F.lit(conflicting)
    sign = F.contains(text, F.lit("%"))
    sure = sign | (said("%", "percent") & ~said(*SPREAD) & ~conflict)
    places = lambda x: F.length(F.regexp_extract(x, r"\.([0-9]+)$", 1))
    value = lambda x, exact, role, precision: F.struct(x.alias("surface"), exact.alias("exact"), role.cast("string").alias("role"), precision.cast("int").alias("display_precision"))
    none = F.lit(None)
    count = lambda x, role: value(x, number(x).cast("string"), role, none)
    percent = lambda x: value(x, x, F.when(sure, "percent"), places(x))
    part = lambda pattern, k: F.regexp_extract(text, pattern, k)
    ratio = F.array(count(part(RATIO, 1), F.when(sure, "count")), count(part(RATIO, 2), F.when(sure, "explicit_ratio_denominator")), percent(part(RATIO, 3)))
    pair = F.array(count(part(PAIR, 1), F.when(sure, "count")), percent(part(PAIR, 2)))
    single = part(PCT_ONLY, 1)
    counted = ~conflict & any_like(headers, COUNT_HEAD) & like(text, COUNT_ONLY)
    alone = F.array(value(single, single, F.when(sure, "percent").when(counted, "count"), places(single)))
    empty = F.array().cast("array<struct<surface:string,exact:string,role:string,display_precision:int>>")
    return F.when(like(text, RATIO), ratio).when(like(text, PAIR), pair).when(like(text, PCT_ONLY), alone).otherwise(empty)
