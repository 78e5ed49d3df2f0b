"""Evidence bundles and their event chains: integrity, context flags, readiness, registry lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyproof.operators import lineage

# Event kinds, decisions, and how old a check of a source's status may be.
KINDS = ("INQUIRY_RECORDED", "AUTHOR_POSITION_RECORDED", "CORRECTION_NOTICE_RECORDED", "REVISION_WITNESS_RECHECK", "CASE_WITHDRAWN", "CASE_REOPENED")
DECISIONS = {"REFUTED_FOR_FORMALIZATION": "FORMALIZATION_COUNTEREXAMPLE_VERIFIED", "NO_REFUTATION_AT_WITNESS": "NO_REFUTATION_AT_WITNESS", "INCONCLUSIVE_INTERVAL": "INCONCLUSIVE_INTERVAL"}
FRESH_DAYS = 30
DEVICES = r"(?i)^(?:con|prn|aux|nul|com[1-9]|lpt[1-9])(?:\.|$)"


def safe_path(path: Column) -> Column:
    """Is a bundle's file name relative, without climbing, drive letters, device names or odd signs."""
    parts = F.split(path, "/")
    bad = lambda p: p.isin("", ".", "..") | F.regexp_like(p, F.lit(DEVICES)) | F.endswith(p, F.lit(".")) | F.endswith(p, F.lit(" "))
    ok = (F.length(path).between(1, 240)) & F.regexp_like(path, F.lit(r"^[A-Za-z0-9._ /-]+$")) & ~F.exists(parts, bad)
    return F.coalesce(ok, F.lit(False))


def integrity(bundles: DataFrame, files: DataFrame) -> DataFrame:
    """Each declared artifact of (bundle_id, artifacts map name -> sha256) against files (bundle_id, name, content)."""
    want = bundles.select("bundle_id", F.explode("artifacts").alias("name", "sha256"))
    got = files.select("bundle_id", "name", F.sha2("content", 256).alias("found"), F.octet_length("content").alias("bytes"))
    rows = want.join(got, ["bundle_id", "name"], "left")
    state = F.when(~safe_path(F.col("name")), "path_refused").when(F.col("found").isNull(), "missing").when(F.col("found") == F.col("sha256"), "intact").otherwise("hash_mismatch")
    return rows.withColumn("state", state)


def quote_at(content: Column, offset: Column, quote: Column) -> Column:
    """Does the quote stand at this byte offset."""
    raw = F.encode(quote, "UTF-8")
    return F.coalesce(F.substring(content, offset.cast("int") + 1, F.octet_length(raw)) == raw, F.lit(False))


def context_flags(cases: DataFrame, as_of: str) -> DataFrame:
    """Decision and flags of (checked_status, status_checked_on, correction_state, captured)."""
    decision = F.create_map(*(F.lit(x) for kv in DECISIONS.items() for x in kv))[F.col("checked_status")]
    age = F.date_diff(F.lit(as_of).cast("date"), F.try_to_date("status_checked_on"))
    flags = F.array_compact(F.array(
        F.when(~F.coalesce("captured", F.lit(False)), "SOURCE_NOT_CAPTURED"), F.when(age.isNull(), "STATUS_DATE_INVALID"), F.when(age < 0, "STATUS_DATE_IN_FUTURE"),
        F.when(age > FRESH_DAYS, "STATUS_CHECK_STALE"), F.when(F.col("correction_state") != "none_found", "CORRECTION_STATUS_OPEN"),
    ))
    return cases.withColumns({"decision": decision, "age_days": age, "flags": flags})


def readiness(cases: DataFrame) -> DataFrame:
    """Blockers in order: the decision, then blocking flags by name; READY where there are none."""
    first = F.when(~F.col("decision").eqNullSafe(F.lit(DECISIONS["REFUTED_FOR_FORMALIZATION"])), F.lit("NO_VERIFIED_COUNTEREXAMPLE"))
    blockers = F.array_distinct(F.concat(F.array_compact(F.array(first)), F.array_sort("flags")))
    return cases.withColumn("blockers", blockers).withColumn("readiness", F.when(F.size("blockers") == 0, "READY").otherwise("BLOCKED"))


def fold_timeline(events: DataFrame) -> DataFrame:
    """State of each bundle after its events (bundle_id, seq, previous_sha256, sha256, kind, on_date, data map), or the first thing wrong.

    data holds position, revision_sha256 or recheck_status where the kind has them.
    """
    w = Window.partitionBy("bundle_id").orderBy("seq")
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    kind = F.col("kind")
    flip = F.when(kind == "CASE_WITHDRAWN", True).when(kind == "CASE_REOPENED", False)
    rows = events.withColumns({
        "place": F.row_number().over(w), "want": F.lag("sha256").over(w), "day_before": F.lag("on_date").over(w),
        "withdrawn": F.coalesce(F.last(flip, True).over(upto), F.lit(False)),
        "revision": F.last(F.when(kind == "CORRECTION_NOTICE_RECORDED", F.col("data")["revision_sha256"]), True).over(upto),
    })
    wrong = (
        F.when(F.col("seq") != F.col("place"), "SEQUENCE_NOT_CONTIGUOUS")
        .when((F.col("place") > 1) & ~F.col("previous_sha256").eqNullSafe(F.col("want")), "CHAIN_MISMATCH")
        .when(~kind.isin(*KINDS), "UNKNOWN_KIND")
        .when(F.col("on_date") < F.col("day_before"), "EVENTS_NOT_ORDERED")
        .when(F.col("withdrawn") & (kind != "CASE_REOPENED"), "WITHDRAWN_CASE_NOT_REOPENED")
        .when(~F.col("withdrawn") & (kind == "CASE_REOPENED"), "REOPENED_WITHOUT_WITHDRAWAL")
        .when((kind == "REVISION_WITNESS_RECHECK") & ~F.col("data")["revision_sha256"].eqNullSafe(F.col("revision")), "RECHECK_NOT_OF_LATEST_REVISION")
    )
    resolved = F.when(kind == "CORRECTION_NOTICE_RECORDED", "NOTICE_RECORDED_UNCHECKED").when(
        kind == "REVISION_WITNESS_RECHECK",
        F.create_map(F.lit("REFUTED_FOR_FORMALIZATION"), F.lit("OLD_WITNESS_STILL_REFUTES_REVISION"), F.lit("NO_REFUTATION_AT_WITNESS"), F.lit("OLD_WITNESS_NO_LONGER_REFUTES_REVISION"), F.lit("INCONCLUSIVE_INTERVAL"), F.lit("REVISION_CHECK_INCONCLUSIVE"))[F.col("data")["recheck_status"]],
    )
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("seq")))
    g = rows.withColumns({"wrong": wrong, "resolved": resolved, "flip": flip}).groupBy("bundle_id").agg(
        F.count("*").alias("events"),
        F.min_by("wrong", F.when(F.col("wrong").isNotNull(), F.col("seq"))).alias("error"),
        F.coalesce(F.max(F.when(kind == "INQUIRY_RECORDED", "INQUIRY_RECORDED_NOT_AUTHENTICATED")), F.lit("NOT_RECORDED")).alias("communication"),
        F.coalesce(F.concat(F.upper(last(F.when(kind == "AUTHOR_POSITION_RECORDED", F.col("data")["position"]))), F.lit("_RECORDED_NOT_AUTHENTICATED")), F.lit("NOT_RECORDED")).alias("author_position"),
        last(F.col("resolved")).alias("resolved"), last(F.col("flip")).alias("is_withdrawn"),
    )
    state = F.when(F.col("is_withdrawn"), "WITHDRAWN_BY_OPERATOR").otherwise(F.coalesce("resolved", F.lit("OPEN")))
    ok = F.col("error").isNull()
    return g.select("bundle_id", "events", F.when(ok, "valid").otherwise("invalid").alias("chain"), "error", F.when(ok, F.col("communication")).alias("communication"), F.when(ok, F.col("author_position")).alias("author_position"), F.when(ok, state).alias("resolution"))


def registry_violations(captures: DataFrame) -> DataFrame:
    """(record_id, violation) of captures (record_id, work_family_id, version_id, parent_record_id, source_sha256, captured_at)."""
    c = captures
    parent = c.select(F.col("record_id").alias("parent_record_id"), F.col("work_family_id").alias("pf"), F.col("captured_at").alias("pt"))
    has = F.col("parent_record_id").isNotNull()
    families = Window.partitionBy("source_sha256")
    j = c.join(parent, "parent_record_id", "left").withColumns({
        "dup": F.count("*").over(Window.partitionBy("record_id")) > 1, "version": F.count("*").over(Window.partitionBy("work_family_id", "version_id")) > 1,
        "reuse": F.min("work_family_id").over(families) < F.max("work_family_id").over(families),
    })
    found = F.array_compact(F.array(
        F.when(F.col("dup"), "DUPLICATE_RECORD"), F.when(F.col("version"), "DUPLICATE_VERSION"), F.when(has & F.col("pf").isNull(), "PARENT_MISSING"), F.when(has & (F.col("pf") != F.col("work_family_id")), "PARENT_OF_OTHER_FAMILY"),
        F.when(has & (F.col("pt") > F.col("captured_at")), "PARENT_CAPTURED_LATER"), F.when(F.col("reuse"), "BYTES_REUSED_ACROSS_FAMILIES"),
    ))
    flat = j.select("record_id", F.explode(found).alias("violation"))
    return flat.union(lineage.in_cycles(c.where(has).select(F.col("record_id").alias("id"), F.col("parent_record_id").alias("up"))).select(F.col("id").alias("record_id"), F.lit("PARENT_CYCLE")))
