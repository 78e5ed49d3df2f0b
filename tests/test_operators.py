"""Goldens of table checks, prose, literals, identity, bundles, streams and bundle replay."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tallyproof.operators import bundles, identity, lattice, literals, percent_tables, prose, table_checks
from tallyproof.sources import articles
from tallyproof.sources import bundles as store
from tallyproof.streaming import folds
from tests.test_percent_tables import HEAD, article, table, tr


def parsed(spark, **docs):
    return articles.layouts(spark.createDataFrame([(k, v) for k, v in docs.items()], "doc_id string, content binary"))


def test_count_totals(spark):
    head, said = tr("Category", "Participants", tag="th"), "Mutually exclusive and exhaustive categories of participants"
    body = lambda total: tr("A", "40") + tr("B", "60") + tr("Total", total)
    got = table_checks.count_totals(articles.exploded(parsed(
        spark, ok=article(table(body("100"), head, said)), off=article(table(body("99"), head, said)), silent=article(table(body("99"), head, "Counts")),
        short=article(table(tr("A", "1") + tr("Total", "1"), head, said)), other=article(table(body("99"), tr("X", "Y", tag="th"), said)), last=article(table(tr("A", "1") + tr("B", "2") + tr("C", "3"), head, said)),
    ), "tables")).collect()
    assert {r.doc_id: (r.status, r.reason, r.difference) for r in got} == {
        "ok": ("COUNT_TOTAL_MATCH", None, 0), "off": ("COUNT_TOTAL_MISMATCH_CANDIDATE", None, -1), "silent": ("UNSUPPORTED", "EXHAUSTIVE_DISJOINT_SOURCE_DECLARATION_MISSING", None),
        "short": ("UNSUPPORTED", "TOTAL_ROW_OR_GROUP_STRUCTURE_AMBIGUOUS", None), "other": ("NOT_APPLICABLE", None, None), "last": ("UNSUPPORTED", "FINAL_UNIQUE_TOTAL_ROW_REQUIRED", None),
    }


def test_section_proposals(spark):
    head = tr("Item", "Drug N=40", "Placebo N=50", tag="th")
    rows = tr("Number of patients analysed", "20", "43") + tr("Pain, n (%)", "2 (10.0)", "4 (9.3)") + tr("Number of patients analysed", "51", "71") + tr("Pain, n (%)", "5 (9.8)", "2 (2.9)")
    got = table_checks.section_proposals(articles.exploded(parsed(spark, d=article(table(rows, head))), "tables")).orderBy("proposed_denominator").collect()
    assert [(r.proposed_denominator, r.status, r.expected_percent, r.conflicting_header) for r in got] == [
        (20, "conditional_match", "10.0", True), (43, "conditional_match", "9.3", True), (51, "conditional_match", "9.8", True), (71, "conditional_mismatch", "2.8", True),
    ]


def test_trace_and_layout_text(spark):
    docs = parsed(spark, d=article(table(tr("A", "4 (8.0)"), tr("Item", "Patients N=50, n (%)", tag="th"), "N=60")))
    got = table_checks.denominator_trace(percent_tables.relations(docs), articles.exploded(docs, "tables")).first()
    assert got.conflicting_facts and got.denominator_is_printed and got.roles == ["column_header", "table_caption"]
    text = "Intro\n\fTable 1. Results\nCount (%) N=40\nA  4 (10.0)\nB  4 (11.0)\n"
    lines = table_checks.layout_lines(spark.createDataFrame([("d", text)], "doc_id string, text string"))
    rows = lines.orderBy("line").collect()
    assert [(r.page, r.line) for r in rows][:3] == [(1, 1), (2, 2), (2, 3)] and all(text[r.start :].lstrip("\f").startswith(r.text) for r in rows)
    assert [(r.numerator, r.denominator, r.status) for r in table_checks.layout_relations(lines).orderBy("line").collect()] == [(4, 40, "arithmetic_match"), (4, 40, "arithmetic_mismatch_candidate")]


def test_lattice_overrides(spark):
    rows = [
        ("basis", None, [50], [60], True, False, "conflicting_explicit_table_percentage_basis", None), ("adjusted", None, [50], [], False, True, "adjustment_method_scope_not_mapped", None),
        ("two", None, [50, 60], [], False, False, "conflicting_column_denominators", None), ("ratio", 9, [50], [], False, True, "adjustment_method_scope_not_mapped", None), ("none", None, [], [], False, False, "no_explicit_denominator", None),
    ]
    df = spark.createDataFrame(rows, "k string, ratio_n bigint, header_ns array<bigint>, global_ns array<bigint>, explicit_basis boolean, adjusted boolean, want string, want_d bigint")
    for r in lattice.scope(df).collect():
        assert (r.reason, r.denominator) == (r.want, r.want_d), r.k


def test_lattice_query_judges_prints_above_hundred(spark, tmp_path):
    from pyspark.sql import functions as F

    from tallyproof.functions import exact
    from tallyproof.plans import records

    counts = {("1-URGENT", "F"): 20001, ("1-URGENT", "O"): 20002, ("1-URGENT", "P"): 5, ("2-HIGH", "X"): 3, ("3-MEDIUM", "Q"): 2, ("4-NOT SPECIFIED", "F"): 1, ("5-LOW", "O"): 1}
    cells = spark.createDataFrame([(*k, n) for k, n in counts.items()], "o_orderpriority string, o_orderstatus string, n int")
    cells.select("o_orderpriority", "o_orderstatus", F.explode(F.sequence(F.lit(1), "n"))).drop("col").write.parquet(str(tmp_path / "orders.parquet"))
    got = {(r.o_orderpriority[0], r.o_orderstatus): (r.denominator, r.status) for r in records.pct_scope_lattice(spark, str(tmp_path)).collect()}
    match, off, unclear = "arithmetic_match", "arithmetic_mismatch_candidate", "scope_ambiguous"
    assert got == {
        ("1", "F"): (20011, off), ("1", "O"): (20012, match), ("1", "P"): (15, off), ("2", "X"): (3, off),
        ("3", "Q"): (sum(counts.values()), match), ("4", "F"): (None, unclear), ("5", "O"): (None, unclear),
    }
    # The detector's limits stay: no verdict above 100 or beyond the largest count.
    rows = spark.createDataFrame([(3, 3, "100.1"), (10**9, 2 * 10**9, "50.0"), (1, 2, "50.1"), (1, 2, "fifty")], "n bigint, d bigint, said string")
    said = rows.select(exact.print_status("n", "d", F.col("said")), exact.percent_status("n", "d", F.col("said"))).collect()
    assert [tuple(r) for r in said] == [(off, unclear), (match, unclear), (off, off), (None, unclear)]


def test_prisma(spark):
    said = "A PRISMA review. Records identified: {}; duplicates removed ({}), record screened: {}."
    rows = [
        ("ok", said.format("1,200", 200, "1\u00a0000")), ("off", said.format(100, 20, 79)), ("more", said.format(10, 20, 5)), ("silent", "A systematic review: studies. Records screened by two."), ("other", "Nothing here."),
        ("bases", said.format(10, 2, 8) + " From PubMed."), ("twice", said.format(10, 2, 8) * 2), ("wide", said.format(10**12 + 1, 2, 8)), ("long", "Records screened " + "x" * 8000), ("no review", "Records identified: 10; duplicates removed: 2; records screened: 8"),
        ("sentence", "In this systematic review, 100 records were identified. After removing 20 duplicates, 80 records were screened."),
    ]
    got = {r.doc_id: (r.status, r.reason, r.expected, r.difference) for r in prose.prisma(spark.createDataFrame(rows, "doc_id string, text string"), "text").collect()}
    refused = lambda reason: ("UNSUPPORTED", f"PRISMA_{reason}", None, None)
    assert got == {
        "ok": ("PRISMA_FLOW_BALANCED", None, 1000, 0), "off": ("PRISMA_FLOW_ARITHMETIC_CANDIDATE", None, 80, -1), "more": ("UNSUPPORTED", "PRISMA_DUPLICATES_EXCEED_IDENTIFIED_RECORDS", -10, 15),
        "silent": refused("LABELLED_TRANSITION_NOT_RECOGNIZED"), "bases": refused("SCOPE_OR_STAGE_AMBIGUOUS"), "twice": refused("LABELLED_TRANSITION_NOT_RECOGNIZED"), "wide": refused("COUNT_OUT_OF_BOUNDS"), "long": refused("PARAGRAPH_LIMIT"),
    }


def test_long_chains_are_no_cycles(spark):
    from pyspark.sql import functions as F

    from tallyproof.operators import lineage

    chain = spark.range(300).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("up"))
    assert lineage.in_cycles(chain.where("up is not null")).count() == 0
    ring = spark.range(40).select((F.col("id") + 1000).alias("id"), ((F.col("id") + 1) % 40 + 1000).alias("up")).union(spark.range(5).select((F.col("id") + 2000).alias("id"), F.lit(1003).alias("up")))
    both = chain.union(ring)
    assert {r.id for r in lineage.in_cycles(both.where("up is not null")).collect()} == {*range(1000, 1040), *range(2000, 2005)}
    got = {r.id: r.cycle_length for r in lineage.cycle_lengths(both).collect()}
    assert got == {i: None for i in [*range(300), *range(2000, 2005)]} | {i: 40 for i in range(1000, 1040)}


def test_lines_that_are_no_sentences_are_listed(spark):
    docs = [("a", "For every real x in [0, 2], 3*x <= 7.\nFor every real x it holds.\nplain\n".encode()), ("b", b"For every \xff\xfe"), ("c", ("For every real x in [0, 2], " + "x" * 3000).encode()), ("d", None)]
    rows = literals.scan(literals.lines(spark.createDataFrame(docs, "doc_id string, content binary"))).collect()
    got = {(r.doc_id, r.line): r.code for r in rows}
    assert got == {("a", 1): None, ("a", 2): "SENTENCE_NOT_OF_THE_GRAMMAR", ("b", 1): "NOT_UTF8", ("c", 1): "LINE_LIMIT", ("d", 1): "NOT_UTF8"}


def test_flows(spark):
    rows = [(100, [10, 5], 80, True), (100, [10, 5], 85, True), (100, [10, 5], 85, False), (100, [10], 90, True)]
    df = spark.createDataFrame(rows, "total bigint, exclusions array<bigint>, included bigint, cue boolean")
    assert [r.status for r in prose.check_flow(df, "cue").collect()] == ["FLOW_ARITHMETIC_CANDIDATE", "FLOW_BALANCED", "FLOW_RELATION_AMBIGUOUS", "UNSUPPORTED"]


def test_literals_and_contexts(spark):
    text = (
        "Ünvented text.\r\nFor every real x in [0, 1], 2*x + 1 <= 3.\nFor all real x in [0,1], x <= 1/2.\nFor every real x in [-1,2] and real y in [0,3], 3*x+2*y+5 <= 17.\nFor all real x in [0,1], x*x <= 1.\n"
        "XX-MATH-CONTEXT-BEGIN v1 id=a role=asserted\nFor all real x in [0,1], x <= 1/2.\nXX-MATH-CONTEXT-END v1 id=a\nXX-MATH-CONTEXT-BEGIN v1 id=q role=quoted\nFor all real x in [0,1], x <= 1/2.\nXX-MATH-CONTEXT-END v1 id=q\n"
    ).encode()
    bad = b"XX-MATH-CONTEXT-BEGIN v1 id=a role=asserted\nFor all real x in [0,1], x <= 1/2.\n"
    lines = literals.lines(spark.createDataFrame([("d", text), ("bad", bad)], "doc_id string, content binary"))
    found = literals.scan(lines)
    rows = found.where("doc_id = 'd'").orderBy("line").collect()
    assert [(r.result, r.maximum, r.code) for r in rows[:4]] == [("model_bound_supported", "3", None), ("model_bound_refuted", "1", None), ("model_bound_supported", "17", None), (None, None, "UNSUPPORTED_SENTENCE_MATH")]
    assert all(text[r.byte_start : r.byte_end].decode() == r.text for r in rows)
    got = {(r.doc_id, r.context_id): (r.interpretation, r.code) for r in literals.contexts(lines, found).collect()}
    assert got[("d", "a")] == ("declared_asserted_literal_refuted", None) and got[("d", "q")] == ("declared_quoted_literal_refuted", None)


def test_identity(spark):
    rows = [
        ("a", "10.1234/X", "PMC1", None), ("b", "https://doi.org/10.1234/x", None, "5"), ("c", None, None, "5"), ("d", "10.1234/y", "PMC1", None), ("e", None, "pmc1", None), ("f", None, None, None), ("g", "10.9999/z", None, "77"), ("h", None, "PMC8", "77"),
    ]
    got = {r.candidate_id: (r.group_id, r.unresolved) for r in identity.merge(spark.createDataFrame(rows, "candidate_id string, doi string, pmcid string, pmid string")).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "f", "g": "g", "h": "g"}
    assert got["d"][1] and all("conflicting_doi" in x or "ambiguous" in x for x in got["d"][1])


def test_bundles(spark):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    b = spark.createDataFrame([("b", {"a.txt": sha(b"x"), "gone": sha(b""), "../up": sha(b""), "con.txt": sha(b""), "off": sha(b"1")})], "bundle_id string, artifacts map<string,string>")
    f = spark.createDataFrame([("b", "a.txt", bytearray(b"x")), ("b", "off", bytearray(b"2"))], "bundle_id string, name string, content binary")
    assert {r.name: r.state for r in bundles.integrity(b, f).collect()} == {"a.txt": "intact", "gone": "missing", "../up": "path_refused", "con.txt": "path_refused", "off": "hash_mismatch"}
    q = spark.createDataFrame([(bytearray("né quote".encode()), 4, "quote"), (bytearray(b"quote"), 1, "quote")], "content binary, at int, quote string")
    assert [r[0] for r in q.select(bundles.quote_at(F.col("content"), F.col("at"), F.col("quote"))).collect()] == [True, False]
    cases = spark.createDataFrame([("REFUTED_FOR_FORMALIZATION", "2026-01-01", "none_found", True), ("REFUTED_FOR_FORMALIZATION", "2026-02-30", "open", False), ("INCONCLUSIVE_INTERVAL", "2026-01-20", "none_found", True)], "checked_status string, status_checked_on string, correction_state string, captured boolean")
    got = bundles.readiness(bundles.context_flags(cases, "2026-01-25")).collect()
    assert [(r.readiness, r.blockers) for r in got] == [("READY", []), ("BLOCKED", ["CORRECTION_STATUS_OPEN", "SOURCE_NOT_CAPTURED", "STATUS_DATE_INVALID"]), ("BLOCKED", ["NO_VERIFIED_COUNTEREXAMPLE"])]


def test_timelines(spark):
    def chain(name, events):
        rows, previous = [], "start"
        for k, (kind, day, data) in enumerate(events, 1):
            digest = hashlib.sha256(f"{previous}{kind}{day}".encode()).hexdigest()
            rows.append((name, k, previous, digest, kind, day, data))
            previous = digest
        return rows

    notice, check = {"revision_sha256": "r1"}, {"revision_sha256": "r1", "recheck_status": "NO_REFUTATION_AT_WITNESS"}
    full = [("INQUIRY_RECORDED", "2026-01-01", {}), ("AUTHOR_POSITION_RECORDED", "2026-01-02", {"position": "agrees"}), ("CORRECTION_NOTICE_RECORDED", "2026-01-03", notice), ("REVISION_WITNESS_RECHECK", "2026-01-04", check)]
    rows = chain("full", full) + chain("gone", full + [("CASE_WITHDRAWN", "2026-01-05", {})]) + chain("back", full + [("CASE_WITHDRAWN", "2026-01-05", {}), ("CASE_REOPENED", "2026-01-06", {})])
    rows += chain("late", [("CASE_WITHDRAWN", "2026-01-05", {}), ("INQUIRY_RECORDED", "2026-01-06", {})]) + chain("old", [full[0], ("REVISION_WITNESS_RECHECK", "2026-01-04", check)])
    broken = chain("broken", full)
    broken[2] = (*broken[2][:2], "0" * 64, *broken[2][3:])
    df = spark.createDataFrame(rows + broken, "bundle_id string, seq int, previous_sha256 string, sha256 string, kind string, on_date string, data map<string,string>")
    got = {r.bundle_id: (r.chain, r.error, r.resolution) for r in bundles.fold_timeline(df).collect()}
    done = "OLD_WITNESS_NO_LONGER_REFUTES_REVISION"
    assert got == {
        "full": ("valid", None, done), "gone": ("valid", None, "WITHDRAWN_BY_OPERATOR"), "back": ("valid", None, done), "late": ("invalid", "WITHDRAWN_CASE_NOT_REOPENED", None),
        "old": ("invalid", "RECHECK_NOT_OF_LATEST_REVISION", None), "broken": ("invalid", "CHAIN_MISMATCH", None),
    }


def test_registry_lineage(spark):
    rows = [("a", "f", "1", None, "s1", "2026-01-01"), ("b", "f", "2", "a", "s2", "2026-01-02"), ("c", "g", "1", "a", "s1", "2026-01-02"), ("x", "h", "1", "y", "s3", "2026-01-01"), ("y", "h", "2", "x", "s4", "2026-01-01"), ("z", "k", "1", "nope", "s5", "2026-01-01")]
    df = spark.createDataFrame(rows, "record_id string, work_family_id string, version_id string, parent_record_id string, source_sha256 string, captured_at string")
    got = {(r.record_id, r.violation) for r in bundles.registry_violations(df).collect()}
    assert got == {("c", "PARENT_OF_OTHER_FAMILY"), ("a", "BYTES_REUSED_ACROSS_FAMILIES"), ("c", "BYTES_REUSED_ACROSS_FAMILIES"), ("x", "PARENT_CYCLE"), ("y", "PARENT_CYCLE"), ("z", "PARENT_MISSING")}


def test_stream_equals_batch(spark, tmp_path):
    kinds = ["view", "purchase", "error", "view", "purchase", "view"]
    rows, last = [], {}
    for k in range(24):
        s = f"u{k % 3}"
        seq, previous = last.get(s, (0, None))
        digest = hashlib.sha256(f"{s}{seq}{previous}".encode()).hexdigest()
        rows.append((s, seq + 1, digest, previous if not (s == "u2" and seq == 4) else "broken", kinds[(k * 5) % 6]))
        last[s] = (seq + 1, digest)
    schema = "stream string, seq bigint, hash string, previous_sha256 string, kind string"
    for part in range(3):
        spark.createDataFrame(rows[part * 8 : part * 8 + 8], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = folds.fold_stream(source, ("purchase",), ("error",))
    q = out.writeStream.outputMode("update").format("memory").queryName("fold_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {}
    for r in spark.table("fold_out").collect():
        if r.stream not in got or got[r.stream].seq < r.seq:
            got[r.stream] = r
    for s in ("u0", "u1", "u2"):
        state = (1, "", "never_set", None)
        for r in (x for x in rows if x[0] == s):
            state = folds.advance(state, r[1], r[2], r[3], r[4], ("purchase",), ("error",))
        assert (got[s].seq, got[s].state, got[s].error) == (state[0] - 1, state[2], state[3])
    assert got["u2"].error == "CHAIN_MISMATCH" and got["u0"].error is None


def test_journal_recovery(spark):
    rows = [("r", 1, "work_started", "a"), ("r", 2, "work_completed", "a"), ("r", 3, "work_started", "b")]
    got = folds.recover(spark.createDataFrame(rows, "run_id string, sequence int, event string, work_id string")).collect()
    assert [(r.run_id, r.work_id) for r in got] == [("r", "b")]


def test_bundle_replay(spark, tmp_path):
    docs = parsed(spark, d=article(table(tr("A", "4 (8.0)"), HEAD, "N=50")))
    parts = {"relations": percent_tables.relations(docs), "status": percent_tables.document_status(docs)}
    store.write_bundle(spark, str(tmp_path / "b"), **parts)
    assert all(r.intact and r.reproduced for r in store.replay(spark, str(tmp_path / "b"), **parts).collect())
    with pytest.raises(Exception, match="(?i)already exists"):
        store.write_bundle(spark, str(tmp_path / "b"), **parts)
    changed = store.replay(spark, str(tmp_path / "b"), relations=parts["relations"].withColumn("numerator", F.col("numerator") + 1)).first()
    assert changed.intact and not changed.reproduced
    assert json.loads("{}") == {}


def test_flows_read_from_text(spark):
    start = "Of the 100 participants in cohort {}, we excluded 10 with condition A and 5 with condition B. "
    sure = "The exclusion categories were mutually exclusive and exhaustive, and all remaining participants were included. "
    end = "Finally, {} participants in cohort {} were included."
    texts = {
        "off": start.format("Alpha") + sure + end.format(80, "Alpha"), "ok": start.format("Beta") + sure + end.format(85, "Beta"), "unsure": start.format("Gamma") + end.format(80, "Gamma"),
        "other": start.format("Alpha") + sure + end.format(85, "Beta"), "unit": start.format("Alpha") + sure + "Finally, 85 records were included.", "one": "Of the 100 participants, we excluded 10 with condition A. " + sure + end.format(90, "A"),
        "doubt": start.format("A") + "The categories may overlap. " + sure + end.format(85, "A"), "none": "Nothing was excluded.", "big": "Of the 1,200 patients, we excluded 1,000 without data; 100 with errors. Exclusions were applied sequentially to the remaining. All remaining patients were included. Finally, 100 patients were included.",
    }
    got = {r.doc_id: (r.status, r.reason, r.expected) for r in prose.read_flows(spark.createDataFrame(list(texts.items()), "doc_id string, text string")).collect()}
    assert got == {
        "off": ("FLOW_ARITHMETIC_CANDIDATE", None, 85), "ok": ("FLOW_BALANCED", None, 85), "unsure": ("FLOW_RELATION_AMBIGUOUS", "FLOW_DISJOINTNESS_EXHAUSTIVENESS_OR_SEQUENCE_NOT_EXPLICIT", None),
        "other": ("UNSUPPORTED", "FLOW_OPERAND_SCOPE_MISMATCH", None), "unit": ("UNSUPPORTED", "FLOW_OPERAND_UNIT_MISMATCH", None), "one": ("UNSUPPORTED", "FLOW_NEEDS_TWO_EXCLUSIONS", None),
        "doubt": ("FLOW_RELATION_AMBIGUOUS", "FLOW_RELATION_CUE_CONFLICT", None), "big": ("FLOW_BALANCED", None, 100),
    }


def test_no_family_part_is_dropped_as_the_table_grows(spark):
    from pyspark.sql import functions as F

    from tallyproof.plans.documents import family_tests

    rows = spark.range(140_000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit(0).alias("quality"), F.lit(0).alias("toxic"))
    few = spark.range(50).select("id", F.lit(None).cast("string"), F.lit(1), F.lit(0))
    # A document of 3,000 labels can't be dealt any finer.
    many = spark.range(3000).select(F.lit(7).cast("bigint"), F.lit("de"), F.lit(0), F.lit(0))
    got = family_tests(rows.union(few).union(many)).collect()
    n = lambda lang: sum(r.n for r in got if r.lang == lang)
    assert (n("en"), n(None), n("de")) == (140_000, 50, 3000)
    assert sum(r.lang == "en" for r in got) == 256 and all(r.status == "computed" and r.p_upper for r in got if r.lang != "de")
    assert [(r.status, r.p_upper, r.harm_upper) for r in got if r.lang == "de"] == [("too_many_families", None, None)]
    assert all(r.part < 64 for r in got if r.lang is None)
