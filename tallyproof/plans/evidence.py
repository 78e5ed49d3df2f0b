"""Registered queries of flow graphs, evidence cases, gates, prose, number roles and certificate files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyproof.operators import cases, certificates, flow_graph, projection, scoring
from tallyproof.plans.arithmetic import table
from tallyproof.plans.documents import _SEGMENTS, segment_articles
from tallyproof.sources import articles

Q, SQL = {}, {}


def query(name: str, sql: str):
    def put(f):
        Q[name], SQL[name] = f, sql
        return f

    return put


@query(
    "flow_graphs",
    """
WITH c AS (SELECT c_nationkey AS k, count(*) AS total, count(*) FILTER (c_acctbal < 0) AS gone, count(*) FILTER (c_acctbal >= 0) + c_nationkey % 2 AS left_over FROM customer GROUP BY c_nationkey),
r AS (SELECT *, CASE k % 6 WHEN 1 THEN 'FLOW_GRAPH_DOES_NOT_MATCH_OPERATION' WHEN 2 THEN 'SCOPE_MISMATCH_OR_INCOMPLETE' WHEN 3 THEN 'OVERLAP_NOT_RULED_OUT_OR_RELATION_NOT_EXPLICIT' WHEN 4 THEN 'UNSUPPORTED_FLOW_OPERATOR' END AS reason FROM c)
SELECT k, reason, CASE WHEN reason IS NULL THEN total - gone END AS expected, CASE WHEN reason IS NULL THEN left_over - (total - gone) END AS difference,
  CASE WHEN reason IS NOT NULL THEN 'FLOW_RELATION_AMBIGUOUS' WHEN left_over = total - gone THEN 'FLOW_BALANCED' ELSE 'FLOW_ARITHMETIC_CANDIDATE' END AS status FROM r""",
)
def flow_graphs(spark, sf_dir):
    """Of each nation all customers less those in debt; by the number's rest the graph lacks an edge, mixes scopes, doesn't say that parts are apart, or names another operation."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("total"), F.count_if(F.col("c_acctbal") < 0).alias("gone"), F.count_if(F.col("c_acctbal") >= 0).alias("rest"))
    is_case = lambda n: F.col("k") % 6 == n
    node = lambda i, n, scope: F.struct(F.lit(i).alias("id"), n.cast("bigint").alias("count"), scope.alias("scope"))
    one = F.lit("all")
    edge = lambda a, b, op, apart: F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"), F.lit(op).alias("operation"), F.lit(True).alias("explicit"), apart.alias("disjoint"), F.lit(True).alias("exhaustive"))
    nodes = F.array(node("t", F.col("total"), one), node("x", F.col("gone"), F.when(is_case(2), "other").otherwise("all")), node("r", F.col("rest") + F.col("k") % 2, one))
    both = F.array(edge("t", "x", "subtract", ~is_case(3)), edge("t", "r", "equals_after_operations", F.lit(True)))
    operation = F.struct(F.when(is_case(4), "divide").otherwise("subtract").alias("operator"), F.array(F.lit("t"), F.lit("x")).alias("inputs"), F.lit("r").alias("result"), F.lit(True).alias("explicit"))
    rows = c.select("k", nodes.alias("nodes"), F.when(is_case(1), F.slice(both, F.lit(1), F.lit(1))).otherwise(both).alias("edges"), operation.alias("operation"))
    return flow_graph.check(rows).select("k", "reason", "expected", "difference", "status")


@query(
    "evidence_cases",
    """
SELECT 'case-' || s_suppkey AS case_id, CASE s_suppkey % 6 WHEN 1 THEN 'DISCLOSURE' WHEN 2 THEN 'WITNESS_NOT_MANIFESTED' WHEN 3 THEN 'RESERVED_ARTIFACT' WHEN 4 THEN 'CHECK_DATE,CLAIM_LISTS' WHEN 5 THEN 'FIELDS' ELSE '' END AS violations,
  s_suppkey % 6 = 0 AS digested FROM supplier""",
)
def evidence_cases(spark, sf_dir):
    """A case for each supplier, most of them with something wrong; sound ones have a digest."""
    k = F.col("s_suppkey")
    bad = lambda n, other, usual: F.when(k % 6 == n, other).otherwise(usual)
    h = F.sha2(k.cast("string"), 256)
    case = F.concat(
        F.lit('{"schema_version":"1.0","case_id":"case-'), k.cast("string"), F.lit('","artifacts":{"source.xml":"'), h, F.lit('","'), bad(3, "report.json", "notes.txt"), F.lit('":"'), h, F.lit('","witness.json":"'), h,
        F.lit('"},"source":{"artifact":"source.xml","text_artifact":"source.xml","identifier":"doi:1","version":"1","capture_status":"captured","correction_check":{"checked_on":"'), bad(4, "2026-02-30", "2026-02-20"),
        F.lit('","status":"none_found","evidence_artifact":"source.xml"}},"claim":{"id":"c1","statement":"It holds.","scope":"All.","assumptions":['), bad(4, "", '"none"'),
        F.lit('],"excluded_claims":["others"],"anchor":{"offset":3,"quote":"It"},"formalization":{"kind":"finite_pmf_bound"}},"witness_artifact":"'), bad(2, "gone.json", "witness.json"),
        F.lit('","unresolved_objections":[],"disclosure":"'), bad(1, "public", "private"), F.lit('"'), bad(5, ',"more":1', ""), F.lit("}"),
    )
    rows = cases.validate(table(spark, sf_dir, "supplier").select(F.concat(F.lit("case-"), k.cast("string")).alias("case_id"), case.alias("case")))
    digests = cases.subject_digest(rows).select("case_id", F.lit(True).alias("digested"))
    return rows.join(digests, "case_id", "left").select("case_id", F.array_join("violations", ",").alias("violations"), F.coalesce("digested", F.lit(False)).alias("digested"))


@query(
    "family_gates",
    """
WITH g AS (SELECT l_suppkey AS k, count(*) FILTER (l_returnflag = 'R') AS positive, count(*) FILTER (l_returnflag = 'R' AND l_quantity > 40) AS wins, count(*) FILTER (l_returnflag = 'N') AS negative FROM lineitem GROUP BY l_suppkey),
m AS (SELECT *, k % 7 = 0 AS open, positive BETWEEN 1 AND 2048 AND negative BETWEEN 1 AND 2048 AS sized, positive >= 140 AND negative >= 10 AS sampled, wins >= 6 AND 10 * wins >= 2 * positive AS good FROM g)
SELECT k, CASE WHEN open OR NOT sized THEN 'not_evaluated' WHEN good AND sampled THEN 'met_on_unverified_development_data' ELSE 'not_met_or_sample_inadequate' END AS numeric_thresholds,
  array_to_string(list_filter([CASE WHEN open THEN 'MISSING_OR_UNRESOLVED_ELIGIBLE_FAMILIES' END, CASE WHEN NOT sized THEN 'NO_ENDPOINT_DATA_OR_SIZE_LIMIT' END, CASE WHEN NOT sampled THEN 'DECLARED_MINIMUM_SAMPLE_NOT_MET' END,
    CASE WHEN NOT open AND sized AND NOT (good AND sampled) THEN 'STATISTICAL_OR_PRACTICAL_THRESHOLD_NOT_MET' END], lambda x: x IS NOT NULL), ',') AS reasons FROM m""",
)
def family_gates(spark, sf_dir):
    """Suppliers as studies without losses: their p is 2 to the minus wins, so below 1/40 from six wins on."""
    flag = lambda f: F.col("l_returnflag") == f
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count_if(flag("R")).alias("positive"), F.count_if(flag("R") & (F.col("l_quantity") > 40)).alias("wins"), F.count_if(flag("N")).alias("negative"))
    zero = F.lit(0).cast("bigint")
    g = g.withColumns({
        "losses": zero, "candidate_alarms": zero, "baseline_alarms": zero, "unknown": F.when(F.col("k") % 7 == 0, 3).otherwise(0), "minimum_positive": F.lit(140), "minimum_negative": F.lit(10),
        "alpha": F.lit("1/40"), "safety_alpha": F.lit("1/40"), "margin": F.lit("1"), "gain": F.lit("2/10"),
    })
    return scoring.family_gates(g).select("k", "numeric_thresholds", F.array_join("reasons", ",").alias("reasons"))


@query(
    "body_paragraphs",
    """
WITH k AS (SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, n_name FROM nation),
p(path, status, reason, said) AS (VALUES ('/article[1]/body[1]/p[1]', 'projected', NULL, true), ('/article[1]/body[1]/sec[1]/p[1]', 'excluded', 'holds_more_than_prose', false), ('/article[1]/body[1]/sec[1]/list[1]/list-item[1]/p[1]', 'excluded', 'stands_outside_prose', false),
  ('/article[1]/body[1]/sec[1]/p[2]', 'excluded', 'empty', false), ('/article[1]/body[1]/sec[1]/p[3]', 'projected', NULL, true))
SELECT doc_id, path, status, reason, CASE WHEN said THEN 'About ' || n_name END AS text FROM k, p""",
)
def body_paragraphs(spark, sf_dir):
    p = F.concat(F.lit("<p>About <b>"), F.col("n_name"), F.lit("</b></p>"))
    xml = F.concat(F.lit("<article><front><p>no</p></front><body>"), p, F.lit("<sec><p>See <i><xref>1</xref></i></p><list><list-item><p>item</p></list-item></list><p> </p>"), p, F.lit("</sec></body></article>"))
    docs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("doc_id"), F.encode(xml, "UTF-8").alias("content"))
    found = projection.body_paragraphs(articles.exploded(articles.nodes(docs), "nodes"))
    return found.select("doc_id", "path", "status", "reason", "text")


@query(
    "numeric_roles",
    _SEGMENTS + """
SELECT CAST(c_nationkey AS VARCHAR) AS doc_id, role, exact, display_precision, count(*) AS cells FROM (
  SELECT c_nationkey, 'count' AS role, CAST(n AS VARCHAR) AS exact, NULL AS display_precision FROM s
  UNION ALL SELECT c_nationkey, 'percent', CAST(shown // 10 AS VARCHAR) || '.' || CAST(shown % 10 AS VARCHAR), 1 FROM s) GROUP BY ALL""",
)
def numeric_roles(spark, sf_dir):
    cells = articles.exploded(articles.layouts(segment_articles(spark, sf_dir)), "tables").select("doc_id", F.explode("cells").alias("c")).where("c.section = 'body'")
    values = cells.select("doc_id", F.explode(projection.numeric_values(F.col("c.text"), F.col("c.headers"))).alias("v"))
    return values.groupBy("doc_id", "v.role", "v.exact", "v.display_precision").agg(F.count("*").alias("cells"))


@query(
    "certificate_files",
    """
SELECT CAST(n_nationkey AS VARCHAR) AS file_id, CASE WHEN n_nationkey % 4 = 0 THEN 'read' ELSE 'refused' END AS status,
  CASE n_nationkey % 4 WHEN 1 THEN 'EXTERNAL_CERTIFICATE_PIN_MISMATCH' WHEN 2 THEN 'PROOF_LINE_TOO_LONG_OR_UNTERMINATED' WHEN 3 THEN 'EMPTY_CERTIFICATE_FILE' END AS reason,
  CASE WHEN n_nationkey % 4 = 0 THEN n_nationkey + 1 ELSE 0 END AS leaves, CASE WHEN n_nationkey % 4 = 0 THEN n_nationkey * 0.5 ELSE NULL END::VARCHAR AS bounds FROM nation""",
)
def certificate_files(spark, sf_dir):
    """Files of a header and k + 1 leaves, some changed after they were pinned, cut short or empty; the leaves of sound ones are bounded by the model x <= 1/2."""
    k = F.col("n_nationkey")
    leaf = '{"kind":"bound","lower":[0],"upper":[1],"lambda":[],"nu":[]}\n'
    text = F.concat(F.lit('{"schema":"leaves"}\n'), F.repeat(F.lit(leaf), (k + 1).cast("int")))
    body = F.when(k % 4 == 3, "").when(k % 4 == 2, F.concat(text, F.lit("{"))).otherwise(text)
    pin = F.sha2(F.encode(F.when(k % 4 == 1, F.lit("other")).otherwise(body), "UTF-8"), 256)
    files = table(spark, sf_dir, "nation").select(k.cast("string").alias("file_id"), F.encode(body, "UTF-8").alias("content"), pin.alias("expected_sha256"))
    lines = certificates.certificate_lines(files)
    model = {"bounds": [["0", "1/2"]], "objective": {"coefficients": [[0, "1"]], "constant": "0"}, "inequalities": [], "equalities": [], "products": [], "bound_derivations": [], "partition": {"variables": [0], "grid": 1}}
    numbered = lines.where("leaf is not null").select((F.col("file_id").cast("bigint") * 100_000 + F.col("leaf_ix")).alias("leaf_ix"), "leaf")
    bounds = certificates.leaf_bounds(numbered, model).select(F.floor(F.col("leaf_ix") / 100_000).cast("string").alias("file_id"), (F.col("bound") == "1/2").alias("half"), (F.col("leaf_ix") % 100_000).alias("n"))
    sums = bounds.where("half").groupBy("file_id").agg((F.max("n") * F.lit(5)).alias("tenths"))
    found = lines.groupBy("file_id", "status", "reason").agg(F.count("leaf").alias("leaves")).join(sums, "file_id", "left")
    return found.select("file_id", "status", "reason", "leaves", F.when(F.col("tenths").isNotNull(), F.format_string("%d.%d", F.floor(F.col("tenths") / 10), F.col("tenths") % 10)).alias("bounds"))


@query(
    "audit_reports",
    _SEGMENTS + """
SELECT CAST(c_nationkey AS VARCHAR) AS doc_id, CASE WHEN c_nationkey % 7 IN (3, 5) THEN 'extraction_failed' ELSE 'completed' END AS status,
  CASE c_nationkey % 7 WHEN 3 THEN 'source_hash_mismatch' WHEN 5 THEN 'root_is_not_article' END AS reason, CASE WHEN c_nationkey % 7 IN (3, 5) THEN 0 ELSE 1 END AS tables_inspected,
  CASE WHEN c_nationkey % 7 IN (3, 5) THEN 0 ELSE count(*) END AS relationships_detected, CASE WHEN c_nationkey % 7 IN (3, 5) THEN 0 ELSE count(*) FILTER (shown = units) END AS arithmetic_matches,
  CASE WHEN c_nationkey % 7 IN (3, 5) THEN 0 ELSE count(*) FILTER (shown <> units) END AS mismatch_candidates, 0 AS abstentions FROM s GROUP BY c_nationkey""",
)
def audit_reports(spark, sf_dir):
    """Reports of the segment articles, some with bytes other than expected, some no articles at all."""
    from tallyproof.operators import audit

    k = F.col("doc_id").cast("int") % 7
    docs = segment_articles(spark, sf_dir)
    docs = docs.withColumn("content", F.when(k == 5, F.encode(F.lit("<book/>"), "UTF-8")).otherwise(F.col("content")))
    docs = docs.withColumn("expected_sha256", F.when(k == 3, F.sha2(F.lit("x"), 256)).when(k == 1, F.sha2("content", 256)))
    reports, _ = audit.audit_documents(docs, articles.layouts(docs))
    return reports.select("doc_id", "status", "reason", *(F.col(c).cast("bigint") for c in ("tables_inspected", "relationships_detected", "arithmetic_matches", "mismatch_candidates", "abstentions")))


@query(
    "run_metrics",
    """
WITH a AS (SELECT o_orderkey AS k, o_custkey AS d, o_orderkey % 5 = 0 AS discrepancy, o_orderkey % 7 = 0 AS open_scope, o_orderkey % 10 = 0 AS unsettled FROM orders WHERE o_orderkey % 3 <> 0),
r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN o_custkey + 1 WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey END AS d,
  CASE WHEN o_orderkey % 13 = 0 THEN 'scope_ambiguous' WHEN o_orderkey % 4 = 0 THEN 'arithmetic_mismatch_candidate' ELSE 'arithmetic_match' END AS status, o_orderkey % 17 <> 0 AS anchored FROM orders WHERE o_orderkey % 9 <> 1),
m AS (SELECT a.*, r.d AS rd, r.status, r.k IS NOT NULL AS hit, coalesce(r.anchored, false) AS trusted, coalesce(r.d <> a.d, false) AS different,
  coalesce(r.anchored AND r.status = 'arithmetic_mismatch_candidate', false) AS mismatch FROM a LEFT JOIN r USING (k)),
n AS (SELECT *, mismatch AND NOT different AND NOT open_scope AND rd IS NOT NULL AS credited FROM m)
SELECT count(*) AS annotations, count(*) FILTER (trusted) AS annotated_relationships_surfaced, count(*) FILTER (different) AS parsed_denominator_disagreements, count(*) FILTER (different AND open_scope) AS unresolved_denominator_disagreements,
  count(*) FILTER (different AND NOT open_scope AND trusted AND status <> 'scope_ambiguous') AS incorrect_denominator_assignments, count(*) FILTER (discrepancy AND credited) AS matched_reference_discrepancies,
  count(*) FILTER (discrepancy AND NOT credited) AS missed_reference_discrepancies, count(*) FILTER ((discrepancy AND credited AND unsettled) OR (NOT discrepancy AND mismatch AND open_scope)) AS unresolved_mismatch_candidates,
  count(*) FILTER (NOT discrepancy AND mismatch AND NOT open_scope) AS candidate_false_positives_against_annotations, (SELECT count(*) FROM r) AS relationships_detected,
  (SELECT count(*) FROM r WHERE status = 'arithmetic_match') AS arithmetic_matches, (SELECT count(*) FROM r WHERE status = 'arithmetic_mismatch_candidate') AS mismatch_candidates,
  (SELECT count(*) FROM r WHERE status = 'scope_ambiguous') AS abstentions, (SELECT count(*) FROM r WHERE NOT anchored) AS source_anchor_failures,
  (SELECT count(*) FROM r WHERE k NOT IN (SELECT k FROM a)) AS unannotated_outputs, (SELECT count(*) FROM r WHERE k NOT IN (SELECT k FROM a) AND status = 'arithmetic_mismatch_candidate') AS unreviewed_mismatch_candidates FROM n""",
)
def run_metrics(spark, sf_dir):
    """Orders as annotations and as a run's results, each with gaps, other denominators, open scopes and lost anchors."""
    from tallyproof.operators import audit

    k, d = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    key = [k.cast("string").alias("doc_id"), k.alias("byte_start"), (k + 1).alias("byte_end"), F.lit(1).alias("numerator"), F.lit("1.0").alias("reported_percent")]
    annotations = o.where("o_orderkey % 3 <> 0").select(
        *key, d.alias("denominator"), F.when(k % 7 == 0, "unknown").otherwise("explicit").alias("scope_status"), F.when(k % 5 == 0, audit.CANDIDATE).otherwise(audit.MATCH).alias("arithmetic_status"),
        F.when(k % 10 == 0, "unresolved_scope").otherwise("settled").alias("review_outcome"),
    )
    results = o.where("o_orderkey % 9 <> 1").select(
        *key, F.when(k % 11 == 0, d + 1).when(k % 13 == 0, None).otherwise(d).alias("denominator"), F.when(k % 13 == 0, "scope_ambiguous").when(k % 4 == 0, audit.CANDIDATE).otherwise(audit.MATCH).alias("status"),
        F.lit(None).cast("string").alias("reason"), (k % 17 != 0).alias("anchored"),
    )
    return audit.run_metrics(annotations, results)
