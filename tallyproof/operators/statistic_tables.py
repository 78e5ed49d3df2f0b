"""Tables of one 2 x 2 outcome with a printed odds ratio, and of n, SD and SE columns.

Both are read only where the table itself says what is needed; each refusal is a reason, the first
that holds, in the order of the ladders.
"""

from __future__ import annotations

from decimal import Decimal
from math import isqrt

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyproof.functions import exact
from tallyproof.operators.percent_tables import facts, like
from tallyproof.operators.table_checks import rows_of

# What captions and headers have to say, and words that make a table's scope unclear.
RATIO = r"(?iu)\bunadjusted\s+(?:odds\s+ratio|OR)\b.{0,120}?\bexposed\s+(?:vs\.?|versus)\s+unexposed\b"
SPEAKS = r"(?iu)\bunadjusted\s+(?:odds\s+ratio|OR)\b"
TIMEPOINT = r"(?iu)\b(?:baseline|follow[ -]?up|day\s+[0-9]{1,4}|[0-9]{1,4}[ -]?day|week\s+[0-9]{1,4}|month\s+[0-9]{1,4}|year\s+[0-9]{1,4})\b"
INDEPENDENT = r"(?iu)\b(?:independent\s+groups?|unmatched\s+groups?|mutually\s+exclusive\s+groups?)\b"
COMPLEX = r"(?iu)\b(?:weighted|adjusted|adjustment|model(?:led|ing)?|regression|cluster(?:ed|ing)?|matched|matching|paired|conditional|stratif(?:ied|ication)|crossover|imput(?:ed|ation)|standardized|propensity|bootstrap|multiple time[ -]?points?|repeated[ -]?measures?|missing data|multiple responses?|overlap(?:ping)?)\b"
FORMULA = r"(?iu)\bSE\s*=\s*SD\s*/\s*(?:sqrt|square\s+root\s+of)\s*\(?\s*n\s*\)?"
OBSERVATIONS = r"(?iu)\b(?:independent\s+observations?|independent\s+samples?|independently\s+sampled\s+observations?)\b"
NEGATED = (
    r"(?iu)\b(?:not|never|without|unless|except|instead\s+of|rather\s+than)\b|"
    r"\b(?:non[ -]?independent|dependent\s+(?:samples?|observations?)|correlated\s+(?:samples?|observations?)|correlations?|"
    r"panel|subgroups?|complete[ -]?cases?|available[ -]?cases?|missing\s+(?:data|values?|observations?)|unit\s+conversion|subsamples?)\b"
)
UNCLEAR = (
    r"(?iu)\b(?:weighted|weighting|adjusted|adjustment|covariate|multivariable|multivariate|cluster(?:ed|ing|s)?|cluster\s+robust|imput(?:ed|ation)|"
    r"matched|paired|conditional|stratif(?:ied|ication)|crossover|repeated[ -]?measures?|repeated observations?|longitudinal|"
    r"multiple time[ -]?points?|across visits?|between visits?|baseline and follow[ -]?up|follow[ -]?up and baseline|"
    r"transform(?:ed|ation)?|log[ -]?scale|logarithm(?:ic)?|square[ -]?root|standardized score|z[ -]?score)\b"
)
INTEGER, DECIMAL = r"^(?:0|[1-9][0-9]{0,9})$", r"^(?:0|[1-9][0-9]{0,9})(?:\.[0-9]{1,8})?$"
SIGNED = r"^-?[0-9]{1,10}(?:\.[0-9]{1,8})?$"
ROLES = {"n": "n", "sd": "sd", "standard deviation": "sd", "se": "se", "standard error": "se", "sem": "sem", "standard error of the mean": "sem"}


def ladder(*steps: tuple[Column, str]) -> Column:
    out = F.when(F.coalesce(steps[0][0], F.lit(False)), F.lit(steps[0][1]))
    for holds, said in steps[1:]:
        out = out.when(F.coalesce(holds, F.lit(False)), F.lit(said))
    return out


def around(cells: str = "cells") -> Column:
    return F.concat_ws(" ", F.array("label", "caption"), "foots", F.transform(cells, lambda c: c["text"]))


def odds_ratio_tables(tables: DataFrame) -> DataFrame:
    """One row a table that speaks of an unadjusted odds ratio: cells, printed and recomputed value, status or reason."""
    t = tables.withColumn("context", around()).where(like(F.col("context"), SPEAKS) | F.contains(F.lower("context"), F.lit("2x2")))
    keep = ("table_id", "caption", "foots", "header_bad", "body_bad", "context")
    rows = rows_of(t, *keep)
    role = lambda h: (
        F.when(like(h, SPEAKS), F.when(like(h, RATIO), "statistic"))
        .when(~like(h, r"(?iu)\bevents?\b"), None)
        .otherwise(F.concat(F.when(like(h, r"(?iu)\b(?:unexposed|control|reference)\b"), "unexposed").otherwise("exposed"), F.when(like(h, r"(?iu)\b(?:non[ -]?events?|no events?|without events?)\b"), "_other").otherwise("_event")))
    )
    cells = F.transform("cells", lambda c: F.struct(role(F.array_join(c["headers"], " ")).alias("role"), F.trim(c["text"]).alias("text"), (c["colspan"] == 1).alias("plain"), (c["rowspan"] == 1).alias("flat"), c["col"].alias("col")))
    rows = rows.withColumn("c", cells)
    pick = lambda name: F.get(F.filter("c", lambda x: x["role"] == name), F.lit(0))
    names = {"a": "exposed_event", "b": "exposed_other", "c_": "unexposed_event", "d": "unexposed_other"}
    one = rows.groupBy("doc_id", "table_index", *keep).agg(F.count("*").alias("rows"), F.first("c").alias("c"))
    one = one.withColumns({k: pick(v)["text"] for k, v in names.items()} | {"shown": pick("statistic")["text"], "row_label": F.get("c", F.lit(0))["text"]})
    value = lambda k: F.when(like(F.col(k), INTEGER), F.col(k).try_cast("bigint"))
    four = [value(k) for k in names]
    # "unadjusted" itself holds no word of COMPLEX: that begins at a word's start.
    reason = ladder(
        (F.col("header_bad") | F.col("body_bad"), "TABLE_STRUCTURE_NOT_RELIABLE"),
        (like(F.col("context"), COMPLEX), "MODEL_ADJUSTED_WEIGHTED_OR_COMPLEX_CONTEXT"),
        (~like(F.col("caption"), INDEPENDENT), "INDEPENDENT_GROUPS_NOT_EXPLICIT"),
        (F.size("foots") > 0, "TABLE_FOOTNOTE_SEMANTICS_UNRESOLVED"),
        (F.col("rows") != 1, "ONE_OUTCOME_ROW_REQUIRED"),
        (F.coalesce(F.col("row_label"), F.lit("")) == "", "OUTCOME_ROW_LABEL_MISSING"),
        (~like(F.concat_ws(" ", "row_label", "caption"), TIMEPOINT), "TIMEPOINT_UNSPECIFIED"),
        ((F.size("c") != 6) | (F.size(F.array_distinct(F.filter(F.transform("c", lambda x: x["role"]), lambda r: r.isNotNull()))) != 5), "EXACT_2X2_AND_ORIENTATION_HEADERS_REQUIRED"),
        (F.exists("c", lambda x: ~x["plain"] | ~x["flat"]), "2X2_CELL_MISSING_OR_SPANNED"),
        (F.greatest(*(F.when(v.isNull(), 1).otherwise(0) for v in four)) == 1, "2X2_COUNT_NOT_EXPLICIT_INTEGER"),
        (F.greatest(*four) > 10**9, "2X2_COUNT_OUT_OF_BOUNDS"),
        (~like(F.col("shown"), SIGNED), "REPORTED_ODDS_RATIO_NOT_EXPLICIT_DECIMAL"),
        (F.least(*four) == 0, "ZERO_CELL_POLICY_UNSPECIFIED"),
    )
    one = one.withColumn("reason", reason)
    places = F.length(F.regexp_extract("shown", r"\.([0-9]+)$", 1))
    free = F.col("reason").isNull()
    one = one.withColumns({f"n_{k}": F.when(free, value(k)) for k in names} | {"places": places})
    one = one.withColumn("units", exact.two_by_two(*(f"n_{k}" for k in names), "OR", F.col("places"))["units"])
    units, places = F.col("units"), F.col("places")
    printed = F.when(free, F.replace("shown", F.lit("."), F.lit("")).try_cast("bigint"))
    status = F.when(~free, "UNSUPPORTED").when(units == printed, "CONSISTENT_WITH_ROUNDING").otherwise("ARITHMETIC_CANDIDATE")
    return one.select("doc_id", "table_id", *(value(k).alias(v) for k, v in names.items()), F.col("shown").alias("reported"), exact.print_units(units, places).alias("recomputed"), status.alias("status"), "reason")


def se_verdict(n: int, sd: str, se: str) -> tuple[str, str]:
    """(status, recomputed text) of SE = SD / sqrt(n): rounded value, then printed intervals, on squares of integers."""
    ps, pe = (len(x.partition(".")[2]) for x in (sd, se))
    s, e = int(sd.replace(".", "")), int(se.replace(".", ""))
    # Twice the quotient in units of 10^-pe, as a floor of a root: half up is (that + 1) // 2.
    twice = isqrt(4 * s * s * 100**pe // (n * 100**ps)) if s else 0
    rounded = (twice + 1) // 2
    text = format(Decimal(rounded).scaleb(-pe), "f")
    if rounded == e:
        return "CONSISTENT_WITH_ROUNDING", text
    low, high = lambda x: max(2 * x - 1, 0), lambda x: 2 * x + 1
    k, m = 100**pe, n * 100**ps
    meets = low(s) ** 2 * k < high(e) ** 2 * m and high(s) ** 2 * k > low(e) ** 2 * m
    return ("ROUNDING_COMPATIBLE" if meets else "ARITHMETIC_CANDIDATE"), text


@F.pandas_udf(T.StructType([T.StructField("status", T.StringType()), T.StructField("recomputed", T.StringType())]))
def se_verdicts(n: pd.Series, sd: pd.Series, se: pd.Series) -> pd.DataFrame:
    rows = [se_verdict(int(a), b, c) if b is not None else (None, None) for a, b, c in zip(n.fillna(0), sd, se, strict=True)]
    return pd.DataFrame(rows, columns=["status", "recomputed"])


def se_tables(tables: DataFrame) -> DataFrame:
    """One row a body row of a table with n, SD or SE headers."""
    keep = ("table_id", "caption", "foots", "header_bad", "body_bad", "context")
    kind = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
    cell = lambda c: F.struct(
        kind[F.lower(F.trim(F.element_at(c["headers"], -1)))].alias("role"), F.trim(c["text"]).alias("text"), ((c["colspan"] == 1) & (c["rowspan"] == 1)).alias("plain"),
        F.slice(c["headers"], F.lit(1), F.greatest(F.size(c["headers"]) - 1, F.lit(0))).alias("path"),
    )
    safe = F.transform("cells", lambda c: F.when(F.size(c["headers"]) > 0, cell(c)).otherwise(F.struct(F.lit(None).cast("string").alias("role"), F.trim(c["text"]).alias("text"), F.lit(True).alias("plain"), F.array().cast("array<string>").alias("path"))))
    rows = rows_of(tables.withColumn("context", around()), *keep).withColumn("c", safe)
    rows = rows.where(F.exists("c", lambda x: x["role"].isNotNull()))
    of = lambda r: F.filter("c", lambda x: x["role"] == r)
    rows = rows.withColumns({f"{r}s": of(r) for r in ("n", "sd", "se", "sem")}).withColumn("row_label", F.get("c", F.lit(0))["text"])
    n, sd, se = (F.get(f"{r}s", F.lit(0)) for r in ("n", "sd", "se"))
    sizes = [F.size(f"{r}s") for r in ("n", "sd", "se")]
    reason = ladder(
        (F.col("header_bad") | F.col("body_bad"), "TABLE_STRUCTURE_NOT_RELIABLE"),
        (like(F.col("context"), UNCLEAR) | like(F.col("context"), NEGATED), "TABLE_HAS_SCOPE_OR_TRANSFORM_AMBIGUITY"),
        (F.size("foots") > 0, "FOOTNOTE_SEMANTICS_NOT_RESOLVED"),
        (~like(F.col("caption"), FORMULA) | ~like(F.col("caption"), OBSERVATIONS), "EXPLICIT_INDEPENDENT_SE_FORMULA_REQUIRED"),
        (F.size("sems") > 0, "SEM_HEADER_NOT_ACCEPTED_AS_SE"),
        (F.greatest(*sizes) > 1, "DUPLICATE_OPERAND_COLUMNS"),
        (F.least(*sizes) < 1, "MISSING_REQUIRED_OPERAND_COLUMN"),
        (~(n["plain"] & sd["plain"] & se["plain"]), "OPERAND_CELL_SPANS_MULTIPLE_ROWS_OR_COLUMNS"),
        (F.exists("c", lambda x: F.size(facts(x["text"])) > 0), "FOOTNOTE_CROSS_REFERENCE_OR_SCOPE_CUE_ON_ROW"),
        (F.col("row_label") == "", "ROW_SCOPE_UNSPECIFIED"),
        ((n["path"] != sd["path"]) | (n["path"] != se["path"]), "OPERAND_SCOPE_OR_UNIT_HEADER_MISMATCH"),
        (~like(n["text"], INTEGER) | (n["text"].try_cast("bigint") < 1), "N_NOT_A_POSITIVE_INTEGER"),
        (~like(sd["text"], DECIMAL), "SD_NOT_A_PLAIN_DECIMAL"),
        (~like(se["text"], DECIMAL), "SE_NOT_A_PLAIN_DECIMAL"),
    )
    rows = rows.withColumn("reason", reason).withColumns({"n": n["text"].try_cast("bigint"), "sd": sd["text"], "se": se["text"]})
    free = F.col("reason").isNull()
    got = se_verdicts(F.when(free, F.col("n")), F.when(free, F.col("sd")), F.when(free, F.col("se")))
    return rows.withColumn("v", got).select(
        "doc_id", "table_id", "row", "row_label", "n", "sd", F.col("se").alias("reported_se"), F.col("v.recomputed").alias("recomputed_se"), F.coalesce("v.status", F.lit("UNSUPPORTED")).alias("status"), "reason"
    )
