"""Registered queries of the document, prose and witness operators. Their inputs are written from counts of the star tables."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyproof.functions import exact
from tallyproof.operators import bundles, checkers, identity, literals, percent_tables, table_checks
from tallyproof.plans.arithmetic import table
from tallyproof.sources import articles
from tallyproof.sources.shared import ship_code

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def segment_counts(spark, sf_dir):
    """Customers by nation and segment, the nation's total, and a printed percentage that is off by a unit for some."""
    g = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    g = g.withColumn("d", F.sum("n").over(Window.partitionBy("c_nationkey")))
    units = exact.percent_units("n", "d", 1) + F.col("c_nationkey") % 2
    return g.withColumn("shown", exact.print_units(units, F.lit(1)))


def segment_articles(spark, sf_dir):
    g = segment_counts(spark, sf_dir)
    row = F.concat(F.lit("<tr><td>"), F.col("c_mktsegment"), F.lit("</td><td>"), F.col("n").cast("string"), F.lit(" ("), F.col("shown"), F.lit(")</td></tr>"))
    rows = g.groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_list(row)), "").alias("rows"), F.max("d").alias("d"))
    xml = F.concat(
        F.lit("<article><body><table-wrap id='T1'><caption><p>Customers, N="), F.col("d").cast("string"),
        F.lit("</p></caption><table><thead><tr><th>Segment</th><th>Customers, n (%)</th></tr></thead><tbody>"), F.col("rows"), F.lit("</tbody></table></table-wrap></body></article>"),
    )
    return rows.select(F.col("c_nationkey").cast("string").alias("doc_id"), F.encode(xml, "UTF-8").alias("content"))


_SEGMENTS = """
WITH g AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL),
w AS (SELECT *, CAST(sum(n) OVER (PARTITION BY c_nationkey) AS BIGINT) AS d FROM g),
k AS (SELECT *, (2000 * n + d) // (2 * d) AS units FROM w),
s AS (SELECT *, units + c_nationkey % 2 AS shown FROM k)
"""


@query(
    "article_relations",
    _SEGMENTS + """
SELECT CAST(c_nationkey AS VARCHAR) AS doc_id, n AS numerator, d AS denominator, 'table_caption_or_footnote' AS denominator_scope,
  CAST(shown // 10 AS VARCHAR) || '.' || CAST(shown % 10 AS VARCHAR) AS reported_percent, CAST(units // 10 AS VARCHAR) || '.' || CAST(units % 10 AS VARCHAR) AS expected_percent,
  CASE WHEN shown = units THEN 'arithmetic_match' ELSE 'arithmetic_mismatch_candidate' END AS status, c_mktsegment || ' ' || n || ' (' || CAST(shown // 10 AS VARCHAR) || '.' || CAST(shown % 10 AS VARCHAR) || ')' AS said FROM s""",
)
def article_relations(spark, sf_dir):
    """Articles written and parsed again: one relation for each cell. said joins the row's label and the cell's quote."""
    docs = articles.layouts(segment_articles(spark, sf_dir))
    found = percent_tables.relations(docs)
    cells = articles.exploded(docs, "tables").select("doc_id", F.explode("cells").alias("c"))
    labels = cells.where("c.section = 'body' and c.cell = 0").select("doc_id", (F.col("c.row") + 1).alias("row_index"), F.col("c.text").alias("label"))
    return found.join(labels, ["doc_id", "row_index"]).select(
        "doc_id", "numerator", "denominator", "denominator_scope", "reported_percent", "expected_percent", "status", F.concat_ws(" ", "label", "evidence.cell_quote").alias("said")
    )


@query(
    "article_nodes",
    "WITH g AS (SELECT c_nationkey, count(DISTINCT c_mktsegment) AS k FROM customer GROUP BY 1) SELECT CAST(c_nationkey AS VARCHAR) AS doc_id, 11 + 3 * k AS elements, k AS body_rows FROM g",
)
def article_nodes(spark, sf_dir):
    n = articles.exploded(articles.nodes(segment_articles(spark, sf_dir)), "nodes")
    body = F.col("path").contains("/tbody[1]/tr[") & (F.col("tag") == "tr")
    return n.groupBy("doc_id").agg(F.count("*").alias("elements"), F.count_if(body).alias("body_rows"))


@query(
    "denominator_fact_roles",
    "WITH g AS (SELECT c_nationkey, count(*) AS d FROM customer GROUP BY 1) SELECT CAST(c_nationkey AS VARCHAR) AS doc_id, 'table_caption' AS role, d AS value FROM g",
)
def denominator_fact_roles(spark, sf_dir):
    found = table_checks.denominator_facts(articles.exploded(articles.layouts(segment_articles(spark, sf_dir)), "tables"))
    return found.select("doc_id", "role", "value")


@query(
    "layout_relations",
    _SEGMENTS + """
SELECT CAST(c_nationkey AS VARCHAR) AS doc_id, c_mktsegment AS label, n AS numerator, d AS denominator,
  CASE WHEN shown = units THEN 'arithmetic_match' ELSE 'arithmetic_mismatch_candidate' END AS status FROM s""",
)
def layout_relations(spark, sf_dir):
    g = segment_counts(spark, sf_dir)
    line = F.concat(F.col("c_mktsegment"), F.lit("   "), F.col("n").cast("string"), F.lit(" ("), F.col("shown"), F.lit(")"))
    t = g.groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("rows"), F.max("d").alias("d"))
    text = F.concat(F.lit("Table 1\nCount (%) N="), F.col("d").cast("string"), F.lit("\n"), F.col("rows"))
    lines = table_checks.layout_lines(t.select(F.col("c_nationkey").cast("string").alias("doc_id"), text.alias("text")))
    return table_checks.layout_relations(lines).select("doc_id", "label", "numerator", "denominator", "status")


@query(
    "literal_sentences",
    """
SELECT CAST(p_partkey AS VARCHAR) AS doc_id, CASE WHEN 3 * p_size + p_partkey % 7 <= 150 THEN 'model_bound_supported' ELSE 'model_bound_refuted' END AS result,
  CAST(3 * p_size + p_partkey % 7 AS VARCHAR) AS maximum FROM part""",
)
def literal_sentences(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    text = F.format_string("Some lines first.\nFor every real x in [0, %d], 3*x + %d <= 150.\n", F.col("p_size"), F.col("p_partkey") % 7)
    lines = literals.lines(p.select(F.col("p_partkey").alias("doc_id"), F.encode(text, "UTF-8").alias("content")))
    return literals.scan(lines).select("doc_id", "result", "maximum")


@query(
    "witness_cases",
    """
SELECT CAST(s_suppkey AS VARCHAR) AS case_id, 'modular_linear_system' AS kind,
  CASE WHEN (s_suppkey * 5) % 7 = s_suppkey % 7 THEN 'NO_REFUTATION_AT_WITNESS' ELSE 'INVALID' END AS status,
  CASE WHEN (s_suppkey * 5) % 7 = s_suppkey % 7 THEN NULL ELSE 'NOT_A_SOLUTION' END AS code FROM supplier""",
)
def witness_cases(spark, sf_dir):
    """x = s claimed to solve 5 x = s modulo 7, for each supplier's number s."""
    s = F.col("s_suppkey")
    spec = F.format_string('{"kind":"modular_linear_system","modulus":7,"matrix":[[5]],"rhs":[%d],"conclusion":"has_solution"}', s)
    witness = F.format_string('{"kind":"modular_linear_system","certificate":{"type":"solution","vector":[%d]}}', s)
    cases = table(spark, sf_dir, "supplier").select(s.cast("string").alias("case_id"), spec.alias("formalization"), witness.alias("witness"))
    return checkers.check_cases(cases).select("case_id", "kind", "status", "code")


@query(
    "bundle_integrity",
    """
SELECT CAST(doc_id AS VARCHAR) AS bundle_id, CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'hash_mismatch' ELSE 'intact' END AS state FROM documents""",
)
def bundle_integrity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("bundle_id"), "doc_id", F.col("text").cast("binary").alias("content"))
    declared = F.when(F.col("doc_id") % 7 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("content", 256))
    want = docs.select("bundle_id", F.create_map(F.lit("source.txt"), declared).alias("artifacts"))
    got = docs.where("doc_id % 5 <> 0").select("bundle_id", F.lit("source.txt").alias("name"), "content")
    return bundles.integrity(want, got).select("bundle_id", "state")


@query(
    "registry_violations",
    """
WITH r AS (SELECT o_orderkey AS id, o_custkey % 50 AS fam, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 30 <> 0 THEN o_orderkey - 3 END AS parent FROM orders)
SELECT CAST(r.id AS VARCHAR) AS record_id, CASE WHEN p.id IS NULL THEN 'PARENT_MISSING' ELSE 'PARENT_OF_OTHER_FAMILY' END AS violation
FROM r LEFT JOIN r p ON p.id = r.parent WHERE r.parent IS NOT NULL AND (p.id IS NULL OR p.fam <> r.fam)""",
)
def registry_violations(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    captures = o.select(
        k.cast("string").alias("record_id"), (F.col("o_custkey") % 50).alias("work_family_id"), k.alias("version_id"),
        F.when((k % 3 == 0) & (k % 30 != 0), (k - 3).cast("string")).alias("parent_record_id"), F.sha2(k.cast("string"), 256).alias("source_sha256"), k.alias("captured_at"),
    )
    return bundles.registry_violations(captures)


@query(
    "candidate_components",
    """
WITH h AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_id FROM documents)
SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS candidate_id, lpad(CAST(first_id AS VARCHAR), 12, '0') AS group_id FROM h""",
)
def candidate_components(spark, sf_dir):
    """Documents as records: those of equal text have one DOI, so they are merged."""
    docs = table(spark, sf_dir, "documents")
    doi = F.concat(F.lit("https://doi.org/10.1234/"), F.sha2("text", 256))
    none = F.lit(None).cast("string")
    rows = docs.select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("candidate_id"), doi.alias("doi"), none.alias("pmcid"), none.alias("pmid"))
    return identity.merge(rows).select("candidate_id", "group_id")


@query("exact_family_tests")
def exact_family_tests(spark, sf_dir):
    """Exact p and harm bound of wins and losses by part of a language: big integers, so a Python function on a few rows.

    The exact tests are for at most 2,048 families. A language has 64 parts, doubled until
    they are of half that size on average at most, so none passes it by chance. One that does (a
    document with as many labels) is a row with a status and no results.
    """
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return family_tests(rows)


def family_tests(rows):
    """lang, part, wins, losses, n, p_upper, harm_upper and status of rows (doc_id, lang, quality, toxic)."""
    from tallyproof.functions import statistics
    from tallyproof.functions.rationals import outward

    size = statistics.MAX_FAMILIES // 2
    doublings = F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / F.lit(64 * size))))
    parts = rows.groupBy(F.col("lang").alias("of")).agg(F.pow(F.lit(2), doublings + 6).cast("bigint").alias("parts"))
    dealt = rows.join(parts, F.col("lang").eqNullSafe(F.col("of")))
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts"))
    g = dealt.groupBy("lang", part.alias("part")).agg(F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("wins"), F.count_if((F.col("quality") == 0) & (F.col("toxic") == 1)).alias("losses"), F.count("*").alias("n"))

    def run(frames):
        for f in frames:
            fits = f.n <= statistics.MAX_FAMILIES
            p = [outward(statistics.discordance_p(int(w), int(x)), True) if ok else None for w, x, ok in zip(f.wins, f.losses, fits, strict=True)]
            harm = [outward(statistics.harm_upper(int(x), 0, int(n), Fraction(1, 40)), True) if ok else None for x, n, ok in zip(f.losses, f.n, fits, strict=True)]
            yield f.assign(p_upper=p, harm_upper=harm, status=["computed" if ok else "too_many_families" for ok in fits])

    ship_code(g.sparkSession)
    return g.mapInPandas(run, "lang string, part bigint, wins bigint, losses bigint, n bigint, p_upper string, harm_upper string, status string")


@query(
    "odds_ratio_tables",
    """
WITH t AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS a, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'O') AS b,
  count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'F') AS c, count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'O') AS d FROM lineitem GROUP BY l_suppkey)
SELECT CAST(l_suppkey AS VARCHAR) AS doc_id, a AS exposed_event, b AS exposed_other, c AS unexposed_event, d AS unexposed_other,
  CASE WHEN least(a, b, c, d) = 0 THEN 'UNSUPPORTED' WHEN (200 * a * d + b * c) // (2 * b * c) = 100 THEN 'CONSISTENT_WITH_ROUNDING' ELSE 'ARITHMETIC_CANDIDATE' END AS status,
  CASE WHEN least(a, b, c, d) = 0 THEN 'ZERO_CELL_POLICY_UNSPECIFIED' END AS reason FROM t""",
)
def odds_ratio_tables(spark, sf_dir):
    """Tables that all print 1.00, over the suppliers' flags and statuses."""
    from tallyproof.operators import statistic_tables

    cell = lambda f, s: F.count_if((F.col("l_returnflag") == f) & (F.col("l_linestatus") == s))
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(cell("R", "F").alias("a"), cell("R", "O").alias("b"), cell("N", "F").alias("c"), cell("N", "O").alias("d"))
    heads = ("Outcome", "Exposed event", "Exposed non-event", "Unexposed event", "Unexposed non-event", "Unadjusted odds ratio (exposed vs unexposed)")
    xml = F.format_string(
        "<article><body><table-wrap><caption><p>Independent groups at day 30</p></caption><table><thead><tr>" + "".join(f"<th>{h}</th>" for h in heads)
        + "</tr></thead><tbody><tr><td>Return</td><td>%d</td><td>%d</td><td>%d</td><td>%d</td><td>1.00</td></tr></tbody></table></table-wrap></body></article>", "a", "b", "c", "d",
    )
    docs = articles.layouts(g.select(F.col("l_suppkey").cast("string").alias("doc_id"), F.encode(xml, "UTF-8").alias("content")))
    return statistic_tables.odds_ratio_tables(articles.exploded(docs, "tables")).select(
        "doc_id", "exposed_event", "exposed_other", "unexposed_event", "unexposed_other", "status", "reason"
    )


@query(
    "standard_error_tables",
    """
WITH g AS (SELECT o_custkey, count(*) AS n, CAST(floor(max(o_totalprice)) AS BIGINT) % 9000 + 500 AS sd FROM orders GROUP BY o_custkey),
s AS (SELECT *, CAST(floor(sd / sqrt(n)) AS BIGINT) + (o_custkey % 5) - 2 AS se FROM g)
SELECT CAST(o_custkey AS VARCHAR) AS doc_id, n, sd, se,
  CASE WHEN CAST(n AS HUGEINT) * (2 * se - 1) * (2 * se - 1) <= 4 * sd * sd AND 4 * sd * sd < CAST(n AS HUGEINT) * (2 * se + 1) * (2 * se + 1) THEN 'CONSISTENT_WITH_ROUNDING'
  WHEN (2 * sd + 1) * (2 * sd + 1) > CAST(n AS HUGEINT) * (2 * se - 1) * (2 * se - 1) AND (2 * sd - 1) * (2 * sd - 1) < CAST(n AS HUGEINT) * (2 * se + 1) * (2 * se + 1) THEN 'ROUNDING_COMPATIBLE'
  ELSE 'ARITHMETIC_CANDIDATE' END AS status FROM s WHERE se >= 1""",
)
def standard_error_tables(spark, sf_dir):
    from tallyproof.operators import statistic_tables

    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), (F.floor(F.max("o_totalprice")).cast("bigint") % 9000 + 500).alias("sd"))
    s = g.withColumn("se", F.floor(F.col("sd") / F.sqrt("n")).cast("bigint") + F.col("o_custkey") % 5 - 2).where("se >= 1")
    xml = F.format_string(
        "<article><body><table-wrap><caption><p>Independent observations; SE = SD/sqrt(n).</p></caption><table><thead><tr><th>Measure</th><th>n</th><th>SD</th><th>SE</th></tr></thead>"
        "<tbody><tr><td>Score</td><td>%d</td><td>%d</td><td>%d</td></tr></tbody></table></table-wrap></body></article>", "n", "sd", "se",
    )
    docs = articles.layouts(s.select(F.col("o_custkey").cast("string").alias("doc_id"), F.encode(xml, "UTF-8").alias("content")))
    found = statistic_tables.se_tables(articles.exploded(docs, "tables"))
    return found.select("doc_id", "n", F.col("sd").cast("bigint").alias("sd"), F.col("reported_se").cast("bigint").alias("se"), "status")


@query(
    "witness_kinds",
    """
WITH p AS (SELECT p_partkey AS k, p_size AS s FROM part)
SELECT CAST(k AS VARCHAR) || '-' || kind AS case_id, CASE WHEN CASE kind
  WHEN 'scalar_radical_comparison' THEN s > 25 WHEN 'polynomial_upper_bound' THEN (s % 4) * (s % 4) + 1 > 5 WHEN 'rational_expression_upper_bound' THEN 3 * (s % 4) > 2 * ((s % 4) + 1)
  WHEN 'finite_map_fixed_point' THEN s % 2 = 1 WHEN 'finite_graph_chromatic_lower_bound' THEN s % 3 = 0 WHEN 'finite_field_polynomial_residue' THEN s % 5 IN (1, 4) END
  THEN 'REFUTED_FOR_FORMALIZATION' ELSE 'NO_REFUTATION_AT_WITNESS' END AS status
FROM p, (SELECT unnest(['scalar_radical_comparison', 'polynomial_upper_bound', 'rational_expression_upper_bound', 'finite_map_fixed_point', 'finite_graph_chromatic_lower_bound', 'finite_field_polynomial_residue']) AS kind)""",
)
def witness_kinds(spark, sf_dir):
    """Six kinds of claims for each part's size s: sqrt(s) <= 5; x^2 + 1 <= 5 and 3 x / (x + 1) <= 2 at s mod 4; a fixed point of a shift by s; 3 colours of a square with s mod 3 = 0; no root of x^2 = s modulo 5."""
    k, s = F.col("p_partkey").cast("string"), F.col("p_size")
    box = '{"x":{"lower":"0","lower_closed":true,"upper":"3","upper_closed":true}}'
    x, const = '{"op":"var","name":"x"}', '{"op":"const","value":"%d"}'
    point = F.format_string('"point":{"x":"%d"}', s % 4)
    ring = F.when(s % 3 == 0, '"a":"p","b":"q","c":"p","d":"q"').otherwise('"a":"p","b":"q","c":"r","d":"q"')
    cases = {
        "scalar_radical_comparison": (F.format_string('"left":{"constant":"0","terms":[{"coefficient":"1","radicand":"%d"}]},"upper_bound":{"constant":"5","terms":[]}', s), F.lit("")),
        "polynomial_upper_bound": (F.lit(f'"domain":{box},"terms":[{{"coefficient":"1","powers":{{"x":2}}}},{{"coefficient":"1","powers":{{}}}}],"upper_bound":"5"'), point),
        "rational_expression_upper_bound": (F.lit(f'"domain":{box},"upper_bound":"2","expression":{{"op":"div","left":{{"op":"mul","args":[{const % 3},{x}]}},"right":{{"op":"add","args":[{x},{const % 1}]}}}}'), point),
        "finite_map_fixed_point": (F.lit('"universe":["0","1"],"conclusion":"has_fixed_point"'), F.format_string('"mapping":{"0":"%d","1":"%d"}', s % 2, (s + 1) % 2)),
        "finite_graph_chromatic_lower_bound": (F.lit('"vertices":["a","b","c","d"],"edges":[["a","b"],["b","c"],["c","d"],["a","d"]],"minimum_colors":3'), F.format_string('"coloring":{%s}', ring)),
        "finite_field_polynomial_residue": (
            F.lit('"prime":5,"variables":["x"],"parameters":["c"],"terms":[{"coefficient":1,"powers":{"x":2}},{"coefficient":-1,"powers":{"c":1}}],"point_count_adjustment":0,"modulus":3,"allowed_residues":[0,1]'),
            F.format_string('"parameters":{"c":%d}', s % 5),
        ),
    }
    parts = [
        F.struct(
            F.concat(k, F.lit("-" + kind)).alias("case_id"), F.concat(F.lit(f'{{"kind":"{kind}",'), spec, F.lit("}")).alias("formalization"),
            F.concat(F.lit(f'{{"kind":"{kind}"'), F.when(witness != "", F.concat(F.lit(","), witness)).otherwise(""), F.lit("}")).alias("witness"),
        )
        for kind, (spec, witness) in cases.items()
    ]
    rows = table(spark, sf_dir, "part").select(F.explode(F.array(*parts)).alias("c")).select("c.*")
    return checkers.check_cases(rows).select("case_id", "status")


@query(
    "refused_documents",
    """
WITH n AS (SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 998 WHEN 1 THEN 1001 ELSE 3 END AS k FROM nation)
SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, CASE WHEN n_nationkey % 5 IN (1, 2) THEN 'refused' ELSE 'parsed' END AS status,
  CASE n_nationkey % 5 WHEN 1 THEN 'too_many_relations' WHEN 2 THEN 'declarations_not_accepted' END AS reason, CASE WHEN n_nationkey % 5 IN (1, 2) THEN 0 ELSE k END AS relations FROM n""",
)
def refused_documents(spark, sf_dir):
    """Documents about at and above the limit of relations, and some with a declaration: all have a row, refused ones a reason."""
    k = F.col("n_nationkey")
    size = F.when(k % 5 == 0, 998).when(k % 5 == 1, 1001).otherwise(3)
    rows = F.array_join(F.transform(F.sequence(F.lit(1), size), lambda i: F.concat(F.lit("<tr><td>r</td><td>"), i.cast("string"), F.lit(" (50.0)</td></tr>"))), "")
    xml = F.concat(
        F.when(k % 5 == 2, "<!DOCTYPE article>").otherwise(""), F.lit("<article><body><table-wrap id='T1'><caption><p>Customers, N=2000</p></caption><table><thead><tr><th>Segment</th><th>n (%)</th></tr></thead><tbody>"),
        rows, F.lit("</tbody></table></table-wrap></body></article>"),
    )
    docs = articles.layouts(table(spark, sf_dir, "nation").select(k.cast("string").alias("doc_id"), F.encode(xml, "UTF-8").alias("content")))
    counts = percent_tables.relations(docs).groupBy("doc_id").agg(F.count("*").cast("int").alias("relations"))
    return percent_tables.document_status(docs).join(counts, "doc_id", "left").select("doc_id", "status", "reason", F.coalesce("relations", F.lit(0)).alias("relations"))
