"""Which printed denominator holds for a count, and the reason where none does.

Columns of a row: row_n (bigint or null), ratio_n, and arrays of distinct denominators group_ns,
header_ns, global_ns, total_ns, row_ns; flags. Missing columns count as null, empty or false, so a
source need only give what it has. Steps 1 to 7 take the first that holds; 8 to 14 may write over
an earlier reason, except 12, which only fills in a missing one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARRAYS = ("group_ns", "header_ns", "global_ns", "total_ns", "row_ns")
NUMBERS = ("row_n", "ratio_n")
FLAGS = (
    "bad_header", "bad_spans", "explicit_basis", "row_specific", "row_n_missing", "adjusted", "type_ambiguous", "missing_row", "from_total_row", "has_totals",
)


def complete(rows: DataFrame) -> DataFrame:
    have = set(rows.columns)
    for c in ARRAYS:
        rows = rows.withColumn(c, F.array_distinct(F.coalesce(c, F.array().cast("array<bigint>"))) if c in have else F.array().cast("array<bigint>"))
    for c in NUMBERS:
        rows = rows.withColumn(c, F.col(c).cast("bigint") if c in have else F.lit(None).cast("bigint"))
    for c in FLAGS:
        rows = rows.withColumn(c, F.coalesce(c, F.lit(False)) if c in have else F.lit(False))
    return rows


def same_set(a: str, b: Column) -> Column:
    return F.array_sort(F.col(a)) == F.array_sort(b)


def scope(rows: DataFrame) -> DataFrame:
    """rows with denominator, denominator_scope and reason."""
    r = complete(rows)
    n = lambda c: F.size(c)
    one = lambda c: F.get(c, F.lit(0))
    ratio, row = F.col("ratio_n").isNotNull(), F.col("row_n").isNotNull()
    conflict = (n("group_ns") > 0) & (n("header_ns") > 0) & ~same_set("group_ns", F.col("header_ns"))
    # (condition, denominator, scope, reason), first that holds.
    none, text = F.lit(None).cast("bigint"), lambda s: F.lit(s).cast("string")
    ladder = [
        (ratio, F.col("ratio_n"), "cell_ratio", None),
        (F.col("bad_header"), none, None, "unsupported_header_spans"),
        (F.col("bad_spans"), none, None, "unsupported_data_cell_spans"),
        (row, F.col("row_n"), "row_denominator_column", None),
        (conflict, none, None, "row_group_column_denominator_conflict"),
        (n("group_ns") == 1, one("group_ns"), "row_group", None),
        (n("group_ns") > 1, none, None, "conflicting_row_group_denominators"),
        (n("header_ns") > 1, none, None, "conflicting_column_denominators"),
        (n("header_ns") == 1, one("header_ns"), "column_header", None),
        (n("global_ns") > 1, none, None, "multiple_unscoped_table_denominators"),
        ((n("global_ns") == 1) & F.col("from_total_row"), one("global_ns"), "table_total_row", None),
        (n("global_ns") == 1, one("global_ns"), "table_caption_or_footnote", None),
        (F.lit(True), none, None, "no_explicit_denominator"),
    ]

    def pick(k: int) -> Column:
        value = lambda x: x if isinstance(x, Column) else text(x)
        out = F.when(ladder[0][0], value(ladder[0][k]))
        for step in ladder[1:]:
            out = out.when(step[0], value(step[k]))
        return out

    r = r.withColumns({"d0": pick(1), "s0": pick(2), "r0": pick(3)})
    free = ~ratio & ~row
    over = [
        (F.col("explicit_basis") & ~same_set("global_ns", F.array_compact(F.array("d0"))), "conflicting_explicit_table_percentage_basis"),
        ((F.col("row_specific") | F.col("row_n_missing")) & free, "row_specific_denominator_not_reported"),
        (F.col("adjusted"), "adjustment_method_scope_not_mapped"),
        (free & F.col("has_totals") & ~same_set("header_ns", F.col("total_ns")), "cross_tab_denominator_scope_unclear"),
    ]
    reason = F.col("r0")
    for holds, said in over:
        reason = F.when(holds, F.lit(said)).otherwise(reason)
    disagree = lambda c: ~ratio & (n(c) > 0) & ~F.coalesce(same_set(c, F.array("d0")), F.lit(False))
    row_off, group_off = disagree("row_ns"), disagree("group_ns")
    reason = F.coalesce(reason, F.when(row_off, F.lit("row_level_denominator_scope_unclear")).when(group_off, F.lit("row_group_denominator_scope_unclear")))
    reason = F.when(F.col("type_ambiguous"), F.lit("percentage_context_not_explicit")).otherwise(reason)
    reason = F.coalesce(reason, F.when(free & F.col("missing_row"), F.lit("missing_data_denominator_scope_unclear")))
    # Whatever makes the scope unclear takes the denominator away.
    known = reason.isNull() & ~(row_off | group_off)
    r = r.withColumn("reason", reason).withColumns({"denominator": F.when(known, F.col("d0")), "denominator_scope": F.when(known, F.col("s0"))})
    return r.drop("d0", "s0", "r0")
