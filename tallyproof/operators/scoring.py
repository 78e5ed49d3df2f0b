"""Scoring of detector runs by family of works, with missing outcomes kept in every denominator."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def receipt_states(works: DataFrame, receipts: DataFrame, key: str = "work_id") -> DataFrame:
    """Each work with its receipt; a work without one has the state missing and no alarm."""
    got = receipts.select(key, "status", "alarm", "accepted")
    rows = works.join(got, key, "left")
    return rows.withColumn("status", F.coalesce("status", F.lit("missing"))).withColumn(
        "alarm", F.coalesce("alarm", F.lit(False))
    ).withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def family_scores(states: DataFrame) -> DataFrame:
    """One row a family: detection, alarm, and whether every work of it is completed."""
    positive = F.col("label") == "positive"
    return states.groupBy("family", "label").agg(
        F.count("*").alias("works"),
        F.count_if(F.col("status") == "missing").alias("missing"),
        F.bool_and(F.col("status") == "completed").alias("complete"),
        F.bool_or(F.col("alarm")).alias("alarmed"),
        F.bool_or(positive & (F.col("status") == "completed") & F.col("alarm") & F.col("accepted")).alias("detected"),
    )


def rates(families: DataFrame) -> DataFrame:
    """Counts over all families of a stratum, and what the unfinished ones could at most add."""
    return families.groupBy("label").agg(
        F.count("*").alias("families"),
        F.count_if("detected").alias("detected"),
        F.count_if(F.col("detected") | ~F.col("complete")).alias("detected_at_most"),
        F.count_if("alarmed").alias("alarmed"),
        F.count_if(F.col("alarmed") | ~F.col("complete")).alias("alarmed_at_most"),
    )


def family_state(hit: Column, done: Column) -> Column:
    """Aggregate to three values: true if any work hits, false only if all are completed, else null."""
    return F.when(F.bool_or(F.coalesce(hit, F.lit(False))), F.lit(True)).when(F.bool_and(done), F.lit(False))


def paired_table(families: DataFrame, base: str = "base", cand: str = "cand") -> DataFrame:
    """Families by stratum and the two runs' states, null as unknown."""
    name = lambda c: F.when(F.col(c).isNull(), "unknown").when(F.col(c), "yes").otherwise("no")
    return families.groupBy("stratum", name(base).alias("base_state"), name(cand).alias("cand_state")).agg(F.count("*").alias("families"))


def paired_bounds(families: DataFrame, base: str = "base", cand: str = "cand", favourable: str = "yes") -> DataFrame:
    """Lowest and highest change that the unknown states allow, over all families of a stratum."""
    yes = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    may = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(True)))
    low, high = yes(cand) - may(base), may(cand) - yes(base)
    if favourable == "no":
        low, high = -high, -low
    return families.groupBy("stratum").agg(F.count("*").alias("families"), low.alias("change_low"), high.alias("change_high"))


def frechet_bounds(rows: DataFrame, by: list[str], count: str, total: str) -> DataFrame:
    """Bounds of the joint probability of events with marginals count / total, over a common denominator."""
    n = F.count("*")
    return rows.groupBy(*by).agg(
        F.greatest(F.lit(0).cast("bigint"), F.sum(count) - (n - 1) * F.max(total)).alias("low"),
        F.min(count).alias("high"),
        F.max(total).alias("denominator"),
    )


def compare_runs(annotations: DataFrame, results: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Annotations with what a run found at the same key, and the run's results that no annotation has."""
    matched = annotations.join(results, keys, "left")
    return matched, results.join(annotations.select(*keys).distinct(), keys, "left_anti")


def lost_hits(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys found by the earlier run and not by the later one."""
    return before.select(key).distinct().join(after.select(key), key, "left_anti")


def reconcile(packet: DataFrame) -> DataFrame:
    """State of two reviews of one fact, first rule that holds: r1, r2 are values or null, same_base whether both saw one source."""
    state = (
        F.when(~F.col("same_base"), F.lit("base_conflict"))
        .when(F.col("identical"), F.lit("identical_records"))
        .when(F.col("r1").isNull() & F.col("r2").isNull(), F.lit("both_unresolved"))
        .when(F.col("r1").eqNullSafe(F.col("r2")), F.lit("concordant"))
        .otherwise(F.lit("disagreement"))
    )
    return packet.withColumn("state", state)


def registry_violations(works: DataFrame) -> DataFrame:
    """(work_id, violation) of (work_id, family, source_sha256, label, eligible): one row a work, one label a family, one family a source."""
    from pyspark.sql import Window

    by = lambda c: Window.partitionBy(c)
    kind = F.struct("label", "eligible")
    rows = works.withColumns({
        "twice": F.count("*").over(by("work_id")) > 1, "mixed": F.min(kind).over(by("family")) != F.max(kind).over(by("family")),
        "shared": F.min("family").over(by("source_sha256")) != F.max("family").over(by("source_sha256")),
    })
    found = F.array_compact(F.array(F.when(F.col("twice"), "DUPLICATE_WORK"), F.when(F.col("mixed"), "FAMILY_LABEL_NOT_CONSTANT"), F.when(F.col("shared"), "SOURCE_IN_SEVERAL_FAMILIES")))
    return rows.withColumn("found", found).select("work_id", F.explode("found").alias("violation")).distinct()


#: Kinds of a run's failures by the reason it gave.
SPAN_REASONS = ("unsupported_header_spans", "unsupported_data_cell_spans")
ROUNDING_REASON, METHOD_REASON, CONTEXT_REASON = "source_rounding_convention_not_modeled", "adjustment_method_scope_not_mapped", "percentage_context_not_explicit"


def taxonomy(matched: DataFrame) -> DataFrame:
    """Annotations (denominator) matched with results (found_denominator, status, reason): what kind of outcome, first that holds."""
    kind = (
        F.when(F.col("found_denominator") != F.col("denominator"), "wrong_denominator")
        .when(F.col("status").isNull(), "missing")
        .when(F.col("reason").isin(*SPAN_REASONS), "table_layout")
        .when(F.col("reason") == METHOD_REASON, "adjustment")
        .when(F.col("reason") == ROUNDING_REASON, "rounding")
        .when(F.col("reason") == CONTEXT_REASON, "context_not_explicit")
        .when(F.col("reason").isNotNull(), "other_reason")
        .otherwise("supported")
    )
    return matched.withColumn("outcome", kind)


def family_gates(studies: DataFrame) -> DataFrame:
    """Gates of paired studies, one row each, from the counts of their families.

    studies: positive, wins, losses (families with a signal, and those that only the candidate or
    only the baseline found); negative, candidate_alarms, baseline_alarms; unknown (families without
    an outcome in either run); minimum_positive, minimum_negative; alpha, safety_alpha, margin and
    gain as rationals (text). Metrics only where all outcomes are known and each side has 1 to
    MAX_FAMILIES families; all else keeps a reason.
    """
    from fractions import Fraction

    from tallyproof.functions import statistics
    from tallyproof.functions.rationals import outward
    from tallyproof.sources.shared import ship_code

    complete = F.col("unknown") == 0
    sizes = F.col("positive").between(1, statistics.MAX_FAMILIES) & F.col("negative").between(1, statistics.MAX_FAMILIES)
    enough = (F.col("positive") >= F.col("minimum_positive")) & (F.col("negative") >= F.col("minimum_negative"))

    @F.pandas_udf("struct<p_upper:string,harm_upper:string,significant:boolean,practical:boolean,safe:boolean>")
    def tests(wins: pd.Series, losses: pd.Series, positive: pd.Series, negative: pd.Series, candidate: pd.Series, baseline: pd.Series, alpha: pd.Series, safety: pd.Series, margin: pd.Series, gain: pd.Series) -> pd.DataFrame:
        rows = []
        for w, x, n, m, c, b, a, s, most, least in zip(wins, losses, positive, negative, candidate, baseline, alpha, safety, margin, gain, strict=True):
            if pd.isna(w):
                rows.append((None,) * 5)
                continue
            p, harm = statistics.discordance_p(int(w), int(x)), statistics.harm_upper(int(c), int(b), int(m), Fraction(s))
            rows.append((outward(p, True), outward(harm, True), p < Fraction(a), Fraction(int(w) - int(x), int(n)) >= Fraction(least), harm <= Fraction(most)))
        return pd.DataFrame(rows, columns=["p_upper", "harm_upper", "significant", "practical", "safe"])

    ship_code(studies.sparkSession)
    rows = studies.withColumns({"complete": complete, "computable": sizes, "sample_met": enough})
    names = ("wins", "losses", "positive", "negative", "candidate_alarms", "baseline_alarms")
    rows = rows.withColumn("t", tests(*(F.when(F.col("complete") & F.col("computable"), F.col(c)) for c in names), "alpha", "safety_alpha", "margin", "gain"))
    met = F.col("t.significant") & F.col("t.practical") & F.col("t.safe")
    gate = F.when(~(F.col("complete") & F.col("computable")), "not_evaluated").when(met & F.col("sample_met"), "met_on_unverified_development_data").otherwise("not_met_or_sample_inadequate")
    rows = rows.withColumn("numeric_thresholds", gate)
    reasons = F.array_compact(F.array(
        F.when(~F.col("complete"), "MISSING_OR_UNRESOLVED_ELIGIBLE_FAMILIES"), F.when(~F.col("computable"), "NO_ENDPOINT_DATA_OR_SIZE_LIMIT"), F.when(~F.col("sample_met"), "DECLARED_MINIMUM_SAMPLE_NOT_MET"),
        F.when(F.col("complete") & F.col("computable") & (gate != "met_on_unverified_development_data"), "STATISTICAL_OR_PRACTICAL_THRESHOLD_NOT_MET"),
    ))
    return rows.withColumn("reasons", reasons).select("*", "t.*").drop("t")


def regressions(runs: DataFrame, order: str, hits: str, n: str) -> DataFrame:
    """Runs with those before them; one whose rate is lower (compared by cross products) regresses. One row a run, so one window holds few rows."""
    from pyspark.sql import Window

    w = Window.orderBy(order)
    before = runs.withColumns({"hits_before": F.lag(hits).over(w), "n_before": F.lag(n).over(w)})
    return before.withColumn("regressed", F.coalesce(F.col(hits) * F.col("n_before") < F.col("hits_before") * F.col(n), F.lit(False)))


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(side, n): how many keys only the one frame has, only the other, and both."""
    both = left.select(key, F.lit(True).alias("l")).join(right.select(key, F.lit(True).alias("r")), key, "full")
    side = F.when(F.col("l").isNull(), "only_right").when(F.col("r").isNull(), "only_left").otherwise("both")
    return both.groupBy(side.alias("side")).agg(F.count("*").alias("n"))


def graded(rows: DataFrame, by: str, grade: str, low: int, high: int) -> DataFrame:
    """Counts by a column and a grade, zeros included: every value is given all grades before the join."""
    grades = F.explode(F.sequence(F.lit(low).cast("bigint"), F.lit(high).cast("bigint"))).alias(grade)
    n = rows.groupBy(by, grade).agg(F.count("*").alias("n"))
    return rows.select(by).distinct().select(by, grades).join(n, [by, grade], "left").select(by, grade, F.coalesce("n", F.lit(0)).alias("n"))
