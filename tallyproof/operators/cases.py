"""Evidence cases as JSON: what is wrong with each, and the digest of what its claim rests on. Columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyproof.operators.bundles import safe_path

# Fields of a case and of its parts, closed vocabularies, kinds of claims, limits and reserved names.
FIELDS = {
    "$": ("schema_version", "case_id", "artifacts", "source", "claim", "witness_artifact", "unresolved_objections", "disclosure"),
    "$.source": ("artifact", "text_artifact", "identifier", "version", "capture_status", "correction_check"),
    "$.source.correction_check": ("checked_on", "status", "evidence_artifact"),
    "$.claim": ("id", "statement", "scope", "assumptions", "excluded_claims", "anchor", "formalization"),
    "$.claim.anchor": ("offset", "quote"),
}
CAPTURED, CORRECTED = ("unverified", "captured", "synthetic"), ("unchecked", "none_found", "present")
KINDS = (
    "scalar_radical_comparison", "polynomial_upper_bound", "rational_expression_upper_bound", "uc_binary_upper_bound", "finite_field_polynomial_residue", "finite_field_quadratic_quartic_residue_rule",
    "finite_map_fixed_point", "finite_graph_chromatic_lower_bound", "finite_pmf_bound", "modular_linear_system",
)
RESERVED = ("case.json", "report.json", "contact-readiness.json", "checksums.sha256")
MAX_ARTIFACTS, MAX_OFFSET = 64, 16 << 20
IDENTIFIER = r"^[A-Za-z0-9_.-]{1,100}$"
CASE = (
    "schema_version string, case_id string, artifacts map<string,string>, source struct<artifact:string,text_artifact:string,identifier:string,version:string,capture_status:string,"
    "correction_check:struct<checked_on:string,status:string,evidence_artifact:string>>, claim struct<id:string,statement:string,scope:string,assumptions:array<string>,excluded_claims:array<string>,"
    "anchor:struct<offset:bigint,quote:string>,formalization:struct<kind:string>>, witness_artifact string, unresolved_objections array<string>, disclosure string"
)
DIGESTED = ("schema_version", "case_id", "source", "claim", "witness_artifact", "unresolved_objections", "disclosure")


def no(c: Column) -> Column:
    return ~F.coalesce(c, F.lit(False))


def said(c: Column, most: int) -> Column:
    return F.coalesce(F.length(F.trim(c)).between(1, most), F.lit(False))


def validate(cases: DataFrame, column: str = "case") -> DataFrame:
    """cases with c, the case as a struct, and violations, an array of what is wrong, in a fixed order; empty for a sound case."""
    raw = F.col(column)
    rows = cases.withColumn("c", F.from_json(raw, CASE))
    c = F.col("c")
    a, src, claim = c["artifacts"], c["source"], c["claim"]
    check, anchor = src["correction_check"], claim["anchor"]
    names = F.map_keys(a)
    lower = F.transform(names, F.lower)
    has = lambda x: F.coalesce(F.map_contains_key(a, x), F.lit(False))
    listed = lambda x, least: F.coalesce(F.size(x).between(least, 64) & F.forall(x, lambda s: said(s, 4000)), F.lit(False))
    sound_fields = F.lit(True)
    for at, want in FIELDS.items():
        part = raw if at == "$" else F.get_json_object(raw, at)
        sound_fields = sound_fields & F.coalesce(F.array_sort(F.json_object_keys(part)) == F.array(*map(F.lit, sorted(want))), F.lit(False))
    prefix = F.exists(lower, lambda n: F.exists(lower, lambda m: F.startswith(m, F.concat(n, F.lit("/")))))
    steps = [
        (~sound_fields, "FIELDS"), (c["schema_version"] != "1.0", "SCHEMA_VERSION"), (no(F.regexp_like(c["case_id"], F.lit(IDENTIFIER))), "CASE_ID"), (no(c["disclosure"] == "private"), "DISCLOSURE"),
        (no(F.size(names).between(1, MAX_ARTIFACTS)), "ARTIFACT_COUNT"), (F.exists(names, lambda n: ~safe_path(n)), "ARTIFACT_PATH"), (F.exists(lower, lambda n: F.element_at(F.split(n, "/"), 1).isin(*RESERVED)), "RESERVED_ARTIFACT"),
        (F.exists(F.map_values(a), lambda h: no(F.regexp_like(h, F.lit("^[0-9a-f]{64}$")))), "ARTIFACT_HASH"), (F.size(F.array_distinct(lower)) != F.size(lower), "ARTIFACT_CASE_COLLISION"), (prefix, "ARTIFACT_PREFIX_COLLISION"),
        (~has(src["artifact"]) | ~has(src["text_artifact"]), "SOURCE_NOT_MANIFESTED"), (~said(src["identifier"], 2000) | ~said(src["version"], 100), "SOURCE_TEXT"), (no(src["capture_status"].isin(*CAPTURED)), "CAPTURE_STATUS"),
        (F.try_to_date(check["checked_on"], "yyyy-MM-dd").isNull(), "CHECK_DATE"), (no(check["status"].isin(*CORRECTED)), "CORRECTION_STATUS"), (~has(check["evidence_artifact"]), "CORRECTION_EVIDENCE"),
        (no(F.regexp_like(claim["id"], F.lit(IDENTIFIER))), "CLAIM_ID"), (~said(claim["statement"], 8000) | ~said(claim["scope"], 4000), "CLAIM_TEXT"),
        (~listed(claim["assumptions"], 1) | ~listed(claim["excluded_claims"], 1), "CLAIM_LISTS"), (no(anchor["offset"].between(0, MAX_OFFSET)) | ~said(anchor["quote"], 8000), "ANCHOR"),
        (no(claim["formalization"]["kind"].isin(*KINDS)), "FORMALIZATION_KIND"), (~has(c["witness_artifact"]), "WITNESS_NOT_MANIFESTED"), (~listed(c["unresolved_objections"], 0), "OBJECTIONS"),
    ]
    found = F.array_compact(F.array(*(F.when(F.coalesce(holds, F.lit(True)), F.lit(name)) for holds, name in steps)))
    return rows.withColumn("violations", F.when(c.isNull() | F.json_object_keys(raw).isNull(), F.array(F.lit("NOT_AN_OBJECT"))).otherwise(found))


def subject_digest(cases: DataFrame, column: str = "case") -> DataFrame:
    """validate()'s sound rows with subject_sha256: the case without what its claim doesn't rest on, and the hashes of the inputs that it does."""
    c, raw = F.col("c"), F.col(column)
    rows = cases.where(F.size("violations") == 0)
    inputs = F.array_sort(F.array_distinct(F.array(c["source"]["artifact"], c["source"]["text_artifact"], c["source"]["correction_check"]["evidence_artifact"], c["witness_artifact"])))
    hashes = F.transform(inputs, lambda n: F.concat(n, F.lit("="), c["artifacts"][n]))
    parts = [F.coalesce(F.get_json_object(raw, f"$.{k}"), F.lit("null")) for k in DIGESTED]
    return rows.withColumn("subject_sha256", F.sha2(F.to_json(F.struct(F.array(*parts).alias("case"), hashes.alias("inputs"))), 256))
