"""Witness cases of the nine baseline sizes, for the benchmark: each is checked in a batch of copies that differ by their number."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyproof.operators import checkers

UNIT = {"lower": "0", "upper": "1", "lower_closed": True, "upper_closed": True}
#: Points of the field's cube times terms: 113 ** 3 * 3.
FIELD = {"prime": 113, "variables": ["x", "y", "z"], "point_count_adjustment": 0, "modulus": 2}
SQUARES = [{"coefficient": 1, "powers": {v: 2}} for v in "xyz"]


def sum_of(n: int) -> dict:
    """A balanced sum of n ones: 2 n - 1 nodes."""
    if n == 1:
        return {"op": "const", "value": "1"}
    return {"op": "add", "args": [sum_of(n // 2), sum_of(n - n // 2)]}


def radical() -> tuple[dict, dict]:
    return {"left": {"constant": "0", "terms": [{"coefficient": "1", "radicand": str(k + 2)} for k in range(32)]}, "upper_bound": {"constant": "0", "terms": []}}, {}


def polynomial() -> tuple[dict, dict]:
    names = [f"x{k}" for k in range(8)]
    return {"domain": dict.fromkeys(names, UNIT), "terms": [{"coefficient": f"{k + 1}/97", "powers": {names[k % 8]: 1 + k // 32}} for k in range(64)], "upper_bound": "0"}, {"point": dict.fromkeys(names, "1")}


def expression() -> tuple[dict, dict]:
    return {"domain": {"x": UNIT}, "expression": sum_of(128), "upper_bound": "127"}, {"point": {"x": "0"}}


def shift() -> tuple[dict, dict]:
    universe = [str(k) for k in range(256)]
    return {"universe": universe, "conclusion": "has_fixed_point"}, {"mapping": dict(zip(universe, universe[1:] + universe[:1], strict=True))}


def bipartite() -> tuple[dict, dict]:
    left, right = ([f"{side}{k}" for k in range(128)] for side in "lr")
    edges = [[a, b] for k, a in enumerate(left) for b in right[k % 2 : 128 : 2]]
    return {"vertices": left + right, "edges": edges, "minimum_colors": 3}, {"coloring": dict.fromkeys(left, "one") | dict.fromkeys(right, "two")}


def masses() -> tuple[dict, dict]:
    names = [f"b{k}" for k in range(8)]
    atoms = [{"assignment": {v: str(k >> i & 1) for i, v in enumerate(names)}, "probability": "1/256"} for k in range(256)]
    event = [{names[k % 8]: "0", names[(k + 1 + k // 8) % 8]: "1"} for k in range(56)] + [{v: "1"} for v in names]
    return {"operation": "probability", "domains": {v: ["0", "1"] for v in names}, "event": event, "relation": "at_most", "bound": "1/4"}, {"atoms": atoms}


def congruences() -> tuple[dict, dict]:
    return {"modulus": 4096, "matrix": [[int(i == j) for j in range(16)] for i in range(16)], "rhs": [0] * 16, "conclusion": "no_solution"}, {"certificate": {"type": "solution", "vector": [0] * 16}}


def residue() -> tuple[dict, dict]:
    return FIELD | {"terms": SQUARES, "parameters": [], "allowed_residues": [0]}, {"parameters": {}}


def power_rule() -> tuple[dict, dict]:
    rule = {k: [0] for k in ("quartic_residue", "quadratic_nonquartic", "quadratic_nonresidue")}
    return FIELD | {"terms": SQUARES, "parameters": ["c"], "classification_parameter": "c", "expected_residues": rule}, {"parameters": {"c": 1}}


#: Name: kind, maker, cases of a batch.
PROFILES: dict[str, tuple[str, Callable[[], tuple[dict, dict]], int]] = {
    "radical_32_terms": ("scalar_radical_comparison", radical, 2048),
    "polynomial_8_variables_64_terms": ("polynomial_upper_bound", polynomial, 4096),
    "expression_255_nodes": ("rational_expression_upper_bound", expression, 4096),
    "map_256_elements": ("finite_map_fixed_point", shift, 4096),
    "graph_256_vertices_8192_edges": ("finite_graph_chromatic_lower_bound", bipartite, 128),
    "masses_256_states_64_clauses": ("finite_pmf_bound", masses, 512),
    "congruences_16_by_16": ("modular_linear_system", congruences, 8192),
    "field_4_3m_term_evaluations": ("finite_field_polynomial_residue", residue, 8),
    "power_rule_4_3m_term_evaluations": ("finite_field_quadratic_quartic_residue_rule", power_rule, 8),
}


def batch(spark: SparkSession, name: str) -> DataFrame:
    """The checked batch of a profile."""
    kind, make, n = PROFILES[name]
    spec, witness = ({"kind": kind} | x for x in make())
    cases = spark.range(n, numPartitions=min(n, spark.sparkContext.defaultParallelism))
    cases = cases.select(F.col("id").cast("string").alias("case_id"), F.lit(json.dumps(spec)).alias("formalization"), F.lit(json.dumps(witness)).alias("witness"))
    return checkers.check_cases(cases)
