"""Exact upper bounds of bilinear models by certificates: a leaf a box, dual weights a leaf.

leaf_bounds() checks leaves in parallel, each on its own; verify() joins them: the largest leaf
bound against the claim, and the boxes against the dyadic partition, merged from the finest halves
up, level by level.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyproof.functions.rationals import Invalid, need, rational, strict_json
from tallyproof.sources.shared import ship_code

MAX_LEAVES = 32_768


def literal(x) -> Fraction:
    return rational(x, 30, True)


def sparse(pairs, size: int, positive: bool = False) -> dict[int, Fraction]:
    out: dict[int, Fraction] = {}
    for k, x in pairs:
        value = literal(x)
        need(type(k) is int and 0 <= k < size and k not in out and value != 0 and (value > 0 or not positive), "SPARSE_VECTOR")
        out[k] = value
    return out


@dataclass
class Model:
    bounds: list[tuple[Fraction, Fraction]]
    objective: dict[int, Fraction]
    constant: Fraction
    inequalities: list[tuple[dict[int, Fraction], Fraction]]
    equalities: list[tuple[dict[int, Fraction], Fraction]]
    products: list[tuple[int, int, int]]
    derivations: list[tuple[int, int]]
    variables: list[int]
    grid: int

    @staticmethod
    def of(m: dict) -> Model:
        bounds = [(literal(a), literal(b)) for a, b in m["bounds"]]
        need(bool(bounds) and all(a <= b for a, b in bounds), "GLOBAL_BOUNDS")
        n = len(bounds)
        rows = lambda name: [(sparse(r["coefficients"], n), literal(r["rhs"])) for r in m[name]]
        equalities = rows("equalities")
        products = [tuple(p) for p in m["products"]]
        need(all(len(p) == 3 and all(0 <= k < n for k in p) and p[2] not in p[:2] for p in products) and len(set(products)) == len(products), "PRODUCTS")
        derivations = [tuple(d) for d in m["bound_derivations"]]
        need(all(0 <= r < len(equalities) and v in equalities[r][0] for v, r in derivations), "DERIVATIONS")
        variables, grid = m["partition"]["variables"], m["partition"]["grid"]
        need(variables == sorted(set(variables)) and variables and all(bounds[v][0] < bounds[v][1] for v in variables), "PARTITION_VARIABLES")
        need(grid > 0 and grid & (grid - 1) == 0, "PARTITION_GRID")
        return Model(bounds, sparse(m["objective"]["coefficients"], n), literal(m["objective"]["constant"]), rows("inequalities"), equalities, products, derivations, variables, grid)

    def box(self, lower: list[int], upper: list[int]) -> tuple[list[Fraction], list[Fraction], bool]:
        """Bounds of all variables in a leaf, narrowed through the named equalities; is it empty."""
        need(len(lower) == len(upper) == len(self.variables) and all(0 <= a < b <= self.grid for a, b in zip(lower, upper, strict=True)), "LEAF_BOX")
        low, high = [list(x) for x in zip(*self.bounds, strict=True)]
        for v, a, b in zip(self.variables, lower, upper, strict=True):
            start, width = self.bounds[v][0], self.bounds[v][1] - self.bounds[v][0]
            low[v], high[v] = start + width * a / self.grid, start + width * b / self.grid
        for target, r in self.derivations:
            row, rhs = self.equalities[r]
            ends = [sorted((k * low[j], k * high[j])) for j, k in row.items() if j != target]
            reach = sorted(((rhs - sum(e[1] for e in ends)) / row[target], (rhs - sum(e[0] for e in ends)) / row[target]))
            low[target], high[target] = max(low[target], reach[0]), min(high[target], reach[1])
            if low[target] > high[target]:
                return low, high, True
        return low, high, False

    def envelope(self, low, high) -> list[tuple[dict[int, Fraction], Fraction]]:
        """Inequality rows, then four for each product w = x y, which hold at the box's corners."""
        rows = list(self.inequalities)
        for x, y, w in self.products:
            for a, b, sign in ((low[x], low[y], -1), (high[x], high[y], -1), (low[x], high[y], 1), (high[x], low[y], 1)):
                row: dict[int, Fraction] = {w: Fraction(sign)}
                for j, k in ((y, -sign * a), (x, -sign * b)):
                    row[j] = row.get(j, Fraction(0)) + k
                rows.append(({j: k for j, k in row.items() if k}, -sign * a * b))
        return rows

    def leaf_bound(self, leaf: dict) -> Fraction | None:
        low, high, empty = self.box(leaf["lower"], leaf["upper"])
        if leaf["kind"] == "empty":
            need(empty, "UNPROVED_EMPTY_LEAF")
            return None
        need(leaf["kind"] == "bound" and not empty, "EMPTY_BOX_REQUIRES_EMPTY_RECORD")
        rows = self.envelope(low, high)
        total, left = self.constant, dict(self.objective)
        for weights, table in ((sparse(leaf["lambda"], len(rows), True), rows), (sparse(leaf["nu"], len(self.equalities)), self.equalities)):
            for r, weight in weights.items():
                row, rhs = table[r]
                total += weight * rhs
                for j, k in row.items():
                    left[j] = left.get(j, Fraction(0)) - weight * k
        return total + sum((k * (high[j] if k >= 0 else low[j]) for j, k in left.items()), Fraction(0))


def leaf_bounds(leaves: DataFrame, model: dict) -> DataFrame:
    """(leaf_ix, lower, upper, bound, code) of (leaf_ix, leaf JSON). The model is one small document."""
    import pyarrow as pa

    schema = "leaf_ix bigint, lower array<int>, upper array<int>, bound string, code string"
    out = pa.schema([("leaf_ix", pa.int64()), ("lower", pa.list_(pa.int32())), ("upper", pa.list_(pa.int32())), ("bound", pa.string()), ("code", pa.string())])

    def run(batches):
        m = Model.of(model)
        for b in batches:
            rows = []
            for ix, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    leaf = strict_json(text)
                    got = m.leaf_bound(leaf)
                    rows.append((ix, leaf["lower"], leaf["upper"], None if got is None else str(got), None))
                except (Invalid, KeyError, TypeError, ValueError) as e:
                    rows.append((ix, None, None, None, str(e) or "LEAF"))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    ship_code(leaves.sparkSession)
    return leaves.select(F.col("leaf_ix").cast("bigint"), F.col("leaf").cast("string")).mapInArrow(run, schema)


def covers(boxes: list[tuple[tuple[int, ...], tuple[int, ...]]], dims: int, grid: int) -> bool:
    """Are the boxes exactly the leaves of a tree that halves the longest side, the first at a tie."""
    wanted, found, todo = set(boxes), 0, [((0,) * dims, (grid,) * dims)]
    if len(wanted) != len(boxes):
        return False
    while todo:
        low, high = todo.pop()
        if (low, high) in wanted:
            found += 1
            continue
        sides = [b - a for a, b in zip(low, high, strict=True)]
        k = sides.index(max(sides))
        if sides[k] < 2 or len(todo) + found > len(boxes):
            return False
        mid = low[k] + sides[k] // 2
        todo += [(low, (*high[:k], mid, *high[k + 1 :])), ((*low[:k], mid, *low[k + 1 :]), high)]
    return found == len(boxes)


def verify(leaves: DataFrame, model: dict, claimed: str) -> dict:
    """The report on a certificate of at most MAX_LEAVES leaves, which bounds what the driver holds."""
    rows = leaf_bounds(leaves, model).limit(MAX_LEAVES + 1).collect()
    need(0 < len(rows) <= MAX_LEAVES, "LEAF_COUNT")
    bad = sorted((r.leaf_ix, r.code) for r in rows if r.code)
    need(not bad, bad[0][1] if bad else "")
    m, target = Model.of(model), literal(claimed)
    bounds = [Fraction(r.bound) for r in rows if r.bound is not None]
    need(all(b <= target for b in bounds), "UPPER_EXCEEDS_CLAIM")
    need(covers([(tuple(r.lower), tuple(r.upper)) for r in rows], len(m.variables), m.grid), "PARTITION_INCOMPLETE")
    best = max(bounds, default=None)
    return {
        "status": "infeasible_model_certified" if best is None else "upper_bound_certified", "verified_upper": None if best is None else str(best),
        "strictly_below_claimed_upper": best is not None and best < target, "checked_leaves": len(rows), "proved_empty_leaves": len(rows) - len(bounds),
    }


def point_value(model: dict, values: list[str]) -> str:
    """The objective at a supplied point, which has to meet every bound, row and product exactly."""
    m = Model.of(model)
    need(isinstance(values, list) and len(values) == len(m.bounds), "POINT_DIMENSION")
    x = [literal(v) for v in values]
    at = lambda row: sum((k * x[j] for j, k in row.items()), Fraction(0))
    need(all(low <= v <= high for v, (low, high) in zip(x, m.bounds, strict=True)), "POINT_BOUNDS")
    need(all(at(row) <= rhs for row, rhs in m.inequalities), "POINT_INEQUALITY")
    need(all(at(row) == rhs for row, rhs in m.equalities), "POINT_EQUALITY")
    need(all(x[a] * x[b] == x[w] for a, b, w in m.products), "POINT_PRODUCT")
    return str(m.constant + at(m.objective))


#: Bytes of a certificate and of one of its lines.
MAX_PROOF_BYTES, MAX_LINE_BYTES = 64 << 20, 256 << 10


def certificate_lines(files: DataFrame) -> DataFrame:
    """(file_id, status, reason, header, leaf_ix, leaf) of files (file_id, content, expected_sha256): one row a leaf; a file that can't be used has one row with a reason.

    The first line is the header. The hash is of the whole file, so that no line can be left out.
    """
    text = F.col("content").cast("string")
    lines = F.split(text, "\n")
    found = F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0)))
    reason = (
        F.when(F.octet_length("content") > MAX_PROOF_BYTES, "PROOF_BYTE_LIMIT")
        .when(F.sha2("content", 256) != F.col("expected_sha256"), "EXTERNAL_CERTIFICATE_PIN_MISMATCH")
        .when(~F.is_valid_utf8(text), "NOT_UTF8")
        .when(F.coalesce(F.octet_length("content"), F.lit(0)) == 0, "EMPTY_CERTIFICATE_FILE")
        .when(~F.endswith(text, F.lit("\n")) | F.exists(lines, lambda x: F.octet_length(x) >= MAX_LINE_BYTES), "PROOF_LINE_TOO_LONG_OR_UNTERMINATED")
        .when(F.size(lines) - 2 > MAX_LEAVES, "PROOF_LINE_COUNT_LIMIT")
    )
    rows = files.select("file_id", reason.alias("reason"), F.when(reason.isNull(), found).alias("found"))
    rows = rows.select("file_id", "reason", F.get("found", F.lit(0)).alias("header"), F.posexplode_outer(F.slice("found", F.lit(2), F.greatest(F.size("found") - 1, F.lit(0)))).alias("leaf_ix", "leaf"))
    return rows.select("file_id", F.when(F.col("reason").isNull(), "read").otherwise("refused").alias("status"), "reason", "header", "leaf_ix", "leaf")
