"""Flow graphs with counted nodes: is the stated operation the graph's, and do the counts add up. Columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The largest count, and the operations that an edge of each kind may name.
MAX_COUNT = 10**12
REMAINDER, REMOVED, ADDED = ("equals_after_operations", "subtract"), ("subtract", "subtract_remaining", "remove_duplicates"), ("add", "sum")

NODE = "struct<id:string,count:bigint,scope:string>"
EDGE = "struct<source:string,target:string,operation:string,explicit:boolean,disjoint:boolean,exhaustive:boolean>"
OPERATION = "struct<operator:string,inputs:array<string>,result:string,explicit:boolean>"


def arrow(a: Column, b: Column) -> Column:
    return F.struct(a.alias("source"), b.alias("target"))


def check(graphs: DataFrame) -> DataFrame:
    """graphs (nodes array, edges array, operation) with expected, difference, status and reason: the first that holds."""
    op, nodes, edges = F.col("operation"), F.col("nodes"), F.col("edges")
    inputs, result = op["inputs"], op["result"]
    first, others = F.get(inputs, F.lit(0)), F.slice(inputs, F.lit(2), F.greatest(F.size(inputs), F.lit(1)))
    rows = graphs.withColumn("of", F.map_from_entries(F.transform(F.array_distinct(F.transform(nodes, lambda n: n["id"])), lambda i: F.struct(i, F.get(F.filter(nodes, lambda n: n["id"] == i), F.lit(0))))))
    node = lambda i: F.col("of")[i]
    used = F.array_append(inputs, result)
    rows = rows.withColumn("used", F.transform(used, node))
    scopes = F.array_distinct(F.transform("used", lambda n: n["scope"]))
    minus, plus = op["operator"] == "subtract", op["operator"] == "add"
    wanted = F.when(minus, F.array_append(F.transform(others, lambda i: arrow(first, i)), arrow(first, result))).otherwise(F.transform(inputs, lambda i: arrow(i, result)))
    drawn = F.transform(edges, lambda e: arrow(e["source"], e["target"]))
    named = lambda e: (
        F.when(plus, e["operation"].isin(*ADDED)).when(e["target"] == result, e["operation"].isin(*REMAINDER)).otherwise(e["operation"].isin(*REMOVED))
    )
    sure = lambda e: F.coalesce(e["explicit"] & e["disjoint"] & e["exhaustive"] & named(e), F.lit(False))
    ordered = lambda x: F.array_sort(F.array_distinct(x))
    reason = (
        F.when(F.size("of") != F.size(nodes), "DUPLICATE_FLOW_NODE_ID")
        .when(F.exists("used", lambda n: n.isNull()), "FLOW_NODE_MISSING")
        .when((F.size(inputs) < 2) | (F.size(F.array_distinct(inputs)) != F.size(inputs)) | F.array_contains(inputs, result), "FLOW_OPERATION_SHAPE_UNSUPPORTED")
        .when(F.exists("used", lambda n: ~F.coalesce(n["count"].between(0, MAX_COUNT), F.lit(False))), "FLOW_COUNT_OUT_OF_BOUNDS")
        .when((F.size(scopes) != 1) | F.get(scopes, F.lit(0)).isNull(), "SCOPE_MISMATCH_OR_INCOMPLETE")
        .when(~F.coalesce(minus | plus, F.lit(False)), "UNSUPPORTED_FLOW_OPERATOR")
        .when(~op["explicit"] | (F.size(F.array_distinct(drawn)) != F.size(edges)) | (ordered(drawn) != ordered(wanted)), "FLOW_GRAPH_DOES_NOT_MATCH_OPERATION")
        .when(~F.forall(edges, sure), "OVERLAP_NOT_RULED_OUT_OR_RELATION_NOT_EXPLICIT")
    )
    rows = rows.withColumn("reason", reason)
    total = lambda ids: F.aggregate(ids, F.lit(0).cast("bigint"), lambda a, i: a + node(i)["count"])
    expected = F.when(F.col("reason").isNull(), F.when(minus, node(first)["count"] - total(others)).otherwise(total(inputs)))
    rows = rows.withColumn("expected", expected).withColumn("difference", node(result)["count"] - F.col("expected"))
    status = F.when(F.col("reason").isNotNull(), "FLOW_RELATION_AMBIGUOUS").when(F.col("difference") == 0, "FLOW_BALANCED").otherwise("FLOW_ARITHMETIC_CANDIDATE")
    return rows.withColumn("status", status).drop("of", "used")
