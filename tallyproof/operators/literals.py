"""Literal universal sentences over boxes of reals, decided exactly, with their byte spans and declared contexts.

    For every real x in [0, 1] and real y in [0,3], 3*x + 2*y <= 5.

Sentences are found by a pattern on lines; a sentence's affine form is read from a whitelisted
syntax tree; its largest value on the box is attained at the corner that the signs choose.
"""

from __future__ import annotations

import ast
import re
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyproof.functions.rationals import Invalid, need, rational
from tallyproof.sources.shared import ship_code

# The sentence's grammar and the directives of a context.
NUMBER = r"-?(?:0|[1-9][0-9]{0,11})(?:/[1-9][0-9]{0,11})?"
NAME = r"[a-z][a-z0-9_]{0,19}"
VARIABLE = rf"real ({NAME}) in \[({NUMBER}), ?({NUMBER})\]"
BARE = re.sub(r"\((?!\?)", "(?:", VARIABLE)
SENTENCE = re.compile(rf"For (every|all|any) ({BARE}(?: and {BARE}){{0,2}}), ([A-Za-z0-9_+*/() \-]{{1,160}}?) (<=|≤|is at most|is no greater than) ({NUMBER})\.")
BEGIN = r"^[A-Z]+-MATH-CONTEXT-BEGIN v1 id=([a-z][a-z0-9_]{0,39}) role=(asserted|quoted|assumption|example|rejected)$"
END = r"^[A-Z]+-MATH-CONTEXT-END v1 id=([a-z][a-z0-9_]{0,39})$"
MARK = "-MATH-CONTEXT-"
STARTS = ("For every real ", "For all real ", "For any real ")
MAX_LINE = 2048


def affine(text: str, names: list[str]) -> tuple[dict[str, Fraction], Fraction]:
    """Coefficients and constant of a text of +, -, *, / by constants, names and integers."""

    def walk(e) -> tuple[dict[str, Fraction], Fraction]:
        if isinstance(e, ast.Constant) and type(e.value) is int:
            return {}, Fraction(e.value)
        if isinstance(e, ast.Name) and e.id in names:
            return {e.id: Fraction(1)}, Fraction(0)
        if isinstance(e, ast.UnaryOp) and isinstance(e.op, (ast.USub, ast.UAdd)):
            return scale(walk(e.operand), Fraction(-1 if isinstance(e.op, ast.USub) else 1))
        need(isinstance(e, ast.BinOp), "UNSUPPORTED_SENTENCE_MATH")
        a, b = walk(e.left), walk(e.right)
        if isinstance(e.op, (ast.Add, ast.Sub)):
            b = scale(b, Fraction(1 if isinstance(e.op, ast.Add) else -1))
            return {k: a[0].get(k, Fraction(0)) + b[0].get(k, Fraction(0)) for k in {*a[0], *b[0]}}, a[1] + b[1]
        if isinstance(e.op, ast.Mult):
            need(not a[0] or not b[0], "UNSUPPORTED_SENTENCE_MATH")
            return scale(b, a[1]) if not a[0] else scale(a, b[1])
        need(isinstance(e.op, ast.Div) and not b[0] and b[1] != 0, "UNSUPPORTED_SENTENCE_MATH")
        return scale(a, 1 / b[1])

    def scale(x, k):
        return {n: c * k for n, c in x[0].items()}, x[1] * k

    try:
        return walk(ast.parse(text.strip(), mode="eval").body)
    except (SyntaxError, RecursionError, MemoryError, ValueError):
        raise Invalid("UNSUPPORTED_SENTENCE_MATH") from None


def decide(sentence: str) -> dict | None:
    m = SENTENCE.fullmatch(sentence)
    if not m:
        return None
    variables = re.findall(VARIABLE, m[2])
    names = [v[0] for v in variables]
    need(len(set(names)) == len(names), "DUPLICATE_VARIABLE")
    box = {n: (rational(a, 30, True), rational(b, 30, True)) for n, a, b in variables}
    need(all(a < b for a, b in box.values()), "SENTENCE_REQUIRES_NONFIXED_RANGE")
    target = rational(m[5], 30, True)
    k, constant = affine(m[3], names)
    at = {n: box[n][1] if k.get(n, 0) > 0 else box[n][0] for n in names}
    top = constant + sum((k.get(n, Fraction(0)) * x for n, x in at.items()), Fraction(0))
    return {"result": "model_bound_supported" if top <= target else "model_bound_refuted", "maximum": str(top), "claimed": str(target), "point": [str(at[n]) for n in names]}


def lines(df: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(doc_id, line, byte_start, byte_end, text) of UTF-8 bytes; LF or CRLF ends a line. Bytes that aren't UTF-8 are one line without text."""
    said = F.col(content).cast("binary").cast("string")
    good = F.is_valid_utf8(said)
    rows = df.select(F.col(key).cast("string").alias("doc_id"), F.posexplode(F.when(good, F.split(said, "\n")).otherwise(F.array(F.lit(None).cast("string")))).alias("k", "raw"))
    upto = Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("byte_start", F.coalesce(F.sum(F.octet_length("raw") + 1).over(upto), F.lit(0)))
    text = F.regexp_replace("raw", r"\r$", "")
    return rows.select("doc_id", (F.col("k") + 1).alias("line"), "byte_start", (F.col("byte_start") + F.octet_length(text)).alias("byte_end"), text.alias("text"))


def scan(rows: DataFrame) -> DataFrame:
    """Lines that begin as a literal sentence, with the exact result or a code: SENTENCE_NOT_OF_THE_GRAMMAR, LINE_LIMIT, NOT_UTF8 (the whole document) and those of decide(). Only such lines reach Python."""
    schema = "doc_id string, line int, byte_start bigint, byte_end bigint, text string, result string, maximum string, claimed string, point array<string>, code string"
    out = pa.schema([("doc_id", pa.string()), ("line", pa.int32()), ("byte_start", pa.int64()), ("byte_end", pa.int64()), ("text", pa.string()), ("result", pa.string()), ("maximum", pa.string()), ("claimed", pa.string()), ("point", pa.list_(pa.string())), ("code", pa.string())])

    def judged(row):
        if row[4] is None:
            return (*row, None, None, None, None, "NOT_UTF8")
        if len(row[4].encode()) > MAX_LINE:
            return (*row, None, None, None, None, "LINE_LIMIT")
        try:
            got = decide(row[4])
        except Invalid as e:
            return (*row, None, None, None, None, str(e))
        if not got:
            return (*row, None, None, None, None, "SENTENCE_NOT_OF_THE_GRAMMAR")
        return (*row, got["result"], got["maximum"], got["claimed"], got["point"], None)

    def run(batches):
        for b in batches:
            found = [judged(row) for row in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), out, strict=True)], schema=out)

    starts = F.col("text").isNull()
    for s in STARTS:
        starts = starts | F.startswith("text", F.lit(s))
    kept = rows.where(starts).select("doc_id", F.col("line").cast("int"), "byte_start", "byte_end", "text")
    ship_code(kept.sparkSession)
    return kept.mapInArrow(run, schema)


def contexts(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Sentences framed by a begin and an end line of one id; any malformed directive refuses its document."""
    w = Window.partitionBy("doc_id").orderBy("line")
    r = rows.withColumns({"before": F.lag("text").over(w), "after": F.lead("text").over(w)})
    begin, end = F.regexp_like("text", F.lit(BEGIN)), F.regexp_like("text", F.lit(END))
    ident = lambda c, p: F.regexp_extract(c, p, 1)
    framed = F.coalesce((ident("before", BEGIN) != "") & (ident("before", BEGIN) == ident("after", END)), F.lit(False))
    marks = r.groupBy("doc_id").agg(
        F.bool_or(F.contains("text", F.lit(MARK)) & ~begin & ~end).alias("malformed"),
        (F.count_if(begin) != F.count_if(framed)).alias("unpaired"), (F.count_if(end) != F.count_if(framed)).alias("loose"),
        (F.count_if(begin) != F.countDistinct(F.when(begin, ident("text", BEGIN)))).alias("repeated"),
    )
    refused = F.col("malformed") | F.col("unpaired") | F.col("loose") | F.col("repeated")
    blocks = r.where(framed).select("doc_id", "line", ident("before", BEGIN).alias("context_id"), F.regexp_extract("before", BEGIN, 2).alias("role"))
    both = blocks.join(found.where("code is null"), ["doc_id", "line"], "left").join(marks, "doc_id")
    said = F.when(refused, F.lit(None).cast("string")).when(F.col("result").isNull(), "unsupported_literal").otherwise(
        F.concat(F.lit("declared_"), F.col("role"), F.lit("_literal_"), F.when(F.col("result") == "model_bound_supported", "supported").otherwise("refuted"))
    )
    return both.select("doc_id", "line", "context_id", "role", said.alias("interpretation"), F.when(refused, "MALFORMED_CONTEXT_DIRECTIVE").alias("code"))
