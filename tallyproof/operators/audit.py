"""Reports on audited documents, and counts of a run against annotations. Columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyproof.operators import percent_tables

MATCH, CANDIDATE = "arithmetic_match", "arithmetic_mismatch_candidate"


def audit_documents(files: DataFrame, parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reports, findings) of files (doc_id, content, expected_sha256 or null) and their articles.layouts().

    A document that can't be read, or whose bytes aren't the expected ones, has a report with a
    reason and no findings. A finding's id is the begin of its source's hash and its number.
    """
    sha = F.sha2("content", 256)
    pinned = F.col("expected_sha256").isNull() | (F.col("expected_sha256") == sha)
    sources = files.select("doc_id", sha.alias("source_sha256"), F.octet_length("content").alias("source_bytes"), pinned.alias("pinned"), F.col("expected_sha256").isNotNull().alias("expected_hash_verified"))
    state = F.when(F.col("status").isin(MATCH, CANDIDATE), F.col("status")).otherwise("extracted_evidence")
    found = percent_tables.relations(parsed).join(sources.where("pinned").select("doc_id", "source_sha256"), "doc_id")
    findings = found.withColumns({"state": state, "finding_id": F.concat(F.substring("source_sha256", 1, 16), F.lit(":"), F.col("relation_ix").cast("string"))})
    of_state = lambda s: F.count_if(F.col("state") == s)
    counts = findings.groupBy("doc_id").agg(F.count("*").alias("relationships_detected"), of_state(MATCH).alias("arithmetic_matches"), of_state(CANDIDATE).alias("mismatch_candidates"), of_state("extracted_evidence").alias("abstentions"))
    tables = parsed.select("doc_id", F.coalesce(F.size("tables"), F.lit(0)).alias("tables_inspected"))
    why = percent_tables.document_status(parsed).select("doc_id", "reason")
    rows = sources.join(why, "doc_id", "left").join(tables, "doc_id", "left").join(counts, "doc_id", "left")
    reason = F.when(~F.col("pinned"), "source_hash_mismatch").otherwise(F.col("reason"))
    numbers = {c: F.coalesce(F.when(reason.isNull(), F.col(c)), F.lit(0)) for c in ("tables_inspected", "relationships_detected", "arithmetic_matches", "mismatch_candidates", "abstentions")}
    reports = rows.select("doc_id", "source_sha256", "source_bytes", "expected_hash_verified", F.when(reason.isNull(), "completed").otherwise("extraction_failed").alias("status"), reason.alias("reason"), *(v.alias(k) for k, v in numbers.items()), F.lit(False).alias("paper_error_established"))
    return reports, findings


KEY = ("doc_id", "byte_start", "byte_end", "numerator", "reported_percent")
UNRESOLVED = ("derived_unresolved", "unknown")


def run_metrics(annotations: DataFrame, results: DataFrame) -> DataFrame:
    """One row: what a run's results count to against annotations.

    annotations: KEY, denominator, scope_status, arithmetic_status, review_outcome. results: KEY,
    denominator, status, reason, anchored (did its evidence hold). One result answers one annotation;
    a key that several results share answers none.
    """
    one = results.groupBy(*KEY).agg(F.count("*").alias("n"), F.first(F.struct("denominator", "status", "reason", "anchored")).alias("r")).where("n = 1").drop("n")
    own = annotations.groupBy(*KEY).agg(F.count("*").alias("n")).where("n = 1").drop("n")
    matched = annotations.join(one.join(own, [*KEY], "left_semi"), [*KEY], "left")
    r, false = F.col("r"), F.lit(False)
    sure = lambda c: F.coalesce(c, false)
    trusted = sure(r["anchored"])
    different = sure(r["denominator"] != F.col("denominator"))
    open_scope = F.col("scope_status").isin(*UNRESOLVED)
    computed = trusted & sure(r["status"].isin(MATCH, CANDIDATE))
    discrepancy = F.col("arithmetic_status") == CANDIDATE
    mismatch = trusted & sure(r["status"] == CANDIDATE)
    credited = mismatch & ~different & ~open_scope & r["denominator"].isNotNull()
    unsettled = F.col("review_outcome").isin("unresolved_scope", "unresolved_rounding")
    flags: dict[str, Column] = {
        "annotated_relationships_surfaced": trusted, "parsed_denominator_disagreements": different, "unresolved_denominator_disagreements": different & open_scope,
        "incorrect_denominator_assignments": different & ~open_scope & computed, "matched_reference_discrepancies": discrepancy & credited, "missed_reference_discrepancies": discrepancy & ~credited,
        "unresolved_mismatch_candidates": (discrepancy & credited & unsettled) | (~discrepancy & mismatch & open_scope), "candidate_false_positives_against_annotations": ~discrepancy & mismatch & ~open_scope,
    }
    here = matched.agg(F.count("*").alias("annotations"), *(F.count_if(c).alias(k) for k, c in flags.items()))
    used = matched.where(r.isNotNull()).select(*KEY)
    rest = results.join(used, [*KEY], "left_anti")
    status = F.col("status")
    all_of = results.agg(
        F.count("*").alias("relationships_detected"), F.count_if(status == MATCH).alias("arithmetic_matches"), F.count_if(status == CANDIDATE).alias("mismatch_candidates"),
        F.count_if(~status.isin(MATCH, CANDIDATE)).alias("abstentions"), F.count_if(~F.col("anchored")).alias("source_anchor_failures"),
    )
    left = rest.agg(F.count("*").alias("unannotated_outputs"), F.count_if(status == CANDIDATE).alias("unreviewed_mismatch_candidates"))
    # Three tables of one row each.
    return here.join(F.broadcast(all_of)).join(F.broadcast(left))
