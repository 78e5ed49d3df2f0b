"""Flows of records and samples in prose: sentences read by patterns, sums checked as integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest paragraph that is read, and the largest count.
MAX_CHARS, MAX_COUNT = 8_000, 10**12
# A count, the labelled transition, and the cues of stage, review and unclear scope.
COUNT = r"([0-9]{1,3}(?:,[0-9]{3})+|[0-9]{1,3}(?:[\u00a0\u202f ][0-9]{3})+|[0-9]{1,13})"
PRISMA = (
    rf"(?Uiu)\brecords?\s+identified\s*[:(]\s*{COUNT}\s*\)?\s*[;,]\s*"
    rf"duplicates?\s+removed\s*[:(]\s*{COUNT}\s*\)?\s*[;,]\s*"
    rf"records?\s+screened\s*[:(]\s*{COUNT}\s*\)?(?![0-9])"
)
STAGE = (
    r"(?Uiu)\b(?:records?\s+(?:identified|screened)|duplicates?\s+removed|full[- ]texts?\s+assessed|studies?\s+included|"
    r"qualitative synthesis|quantitative synthesis)\b"
)
UNSAFE = (
    r"(?Uiu)\b(?:multiple databases?|PubMed|MEDLINE|Embase|Scopus|full[- ]text|reports?\s+assessed|studies?\s+included|"
    r"qualitative|quantitative|overlap(?:ping)?|weighted|adjusted)\b"
)
REVIEW = r"(?Uiu)\b(?:PRISMA|systematic review|literature search)\b"


def to_count(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "").try_cast("bigint")


def prisma(df: DataFrame, text: str) -> DataFrame:
    """Paragraphs of a review that label its records: identified less duplicates against screened.

    Paragraphs without a stage word and review context give no row; too long ones with a stage word
    are refused.
    """
    t = F.col(text)
    long = F.length(t) > MAX_CHARS
    rows = df.where(F.regexp_like(t, F.lit(STAGE)) & (long | F.regexp_like(t, F.lit(REVIEW))))
    hits = F.size(F.regexp_extract_all(t, F.lit(PRISMA), F.lit(0)))
    for k, name in enumerate(("identified", "duplicates", "screened"), 1):
        rows = rows.withColumn(name, F.when((hits == 1) & ~long, to_count(F.regexp_extract(t, PRISMA, k))))
    i, d, s = F.col("identified"), F.col("duplicates"), F.col("screened")
    wide = F.coalesce((i > MAX_COUNT) | (d > MAX_COUNT) | (s > MAX_COUNT), F.lit(True))
    reason = (
        F.when(long, "PRISMA_PARAGRAPH_LIMIT")
        .when(F.regexp_like(t, F.lit(UNSAFE)), "PRISMA_SCOPE_OR_STAGE_AMBIGUOUS")
        .when(hits != 1, "PRISMA_LABELLED_TRANSITION_NOT_RECOGNIZED")
        .when(wide, "PRISMA_COUNT_OUT_OF_BOUNDS")
        .when(d > i, "PRISMA_DUPLICATES_EXCEED_IDENTIFIED_RECORDS")
    )
    rows = rows.withColumn("reason", reason)
    read = F.col("reason").isNull() | (F.col("reason") == "PRISMA_DUPLICATES_EXCEED_IDENTIFIED_RECORDS")
    rows = rows.withColumns({n: F.when(read, F.col(n)) for n in ("identified", "duplicates", "screened")}).withColumn("expected", F.when(read, i - d))
    status = F.when(F.col("reason").isNotNull(), "UNSUPPORTED").when(F.col("expected") == s, "PRISMA_FLOW_BALANCED").otherwise("PRISMA_FLOW_ARITHMETIC_CANDIDATE")
    return rows.withColumn("difference", s - F.col("expected")).withColumn("status", status)


def check_flow(rows: DataFrame, cue: str | None = None) -> DataFrame:
    """total less exclusions (array) against included. cue: a column, false where the text doesn't say that parts are disjoint and exhaustive."""
    total, inc = F.col("total"), F.col("included")
    spent = F.aggregate("exclusions", F.lit(0).cast("bigint"), lambda a, x: a + x)
    bad = lambda c: ~F.coalesce(c.between(0, MAX_COUNT), F.lit(False))
    reason = (
        F.when(bad(total) | bad(inc) | F.exists("exclusions", bad), "FLOW_COUNT_OUT_OF_DOMAIN")
        .when(F.size("exclusions") < 2, "FLOW_NEEDS_TWO_EXCLUSIONS")
        .when(F.size("exclusions") > 32, "FLOW_EXCLUSION_LIMIT")
    )
    rows = rows.withColumn("reason", reason).withColumn("expected", F.when(reason.isNull(), total - spent))
    status = F.when(F.col("reason").isNotNull(), "UNSUPPORTED")
    if cue:
        status = status.when(~F.coalesce(cue, F.lit(False)), "FLOW_RELATION_AMBIGUOUS")
    return rows.withColumn("status", status.when(F.col("expected") == inc, "FLOW_BALANCED").otherwise("FLOW_ARITHMETIC_CANDIDATE"))


# Units of a flow and their common names, and the cues of total, exclusions, inclusion and their relation.
UNIT = r"(participants?|individuals?|persons?|people|patients?|records?|reports?|studies)"
UNITS = {
    "participant": "participant", "participants": "participant", "individual": "participant", "individuals": "participant",
    "person": "participant", "persons": "participant", "people": "participant", "patient": "patient", "patients": "patient",
    "record": "record", "records": "record", "report": "report", "reports": "report", "study": "study", "studies": "study",
}
NUM = r"(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]{1,3}(?:[   ][0-9]{3})+|[0-9]{1,13})"
TOTAL = rf"\b(?:of|among)\s+the\s+({NUM})\s+([^.;:]{{0,120}}?\b{UNIT}\b)"
EXCLUDED = r"\bwe\s+(?:then\s+)?excluded\b"
INCLUDED = rf"\bfinally\s*,?\s*({NUM})\s+([^.;:]{{0,120}}?\b{UNIT}\b[^.;]{{0,160}}?)\b(?:were|was)\s+included\b"
WHOLE = rf"(?is)^.*?{TOTAL}(.*?){EXCLUDED}(.*?){INCLUDED}"
BETWEEN = rf"(?i)(?:,\s+(?:and\s+)?(?={NUM}\s)|;\s*(?:and\s+)?(?={NUM}\s)|\s+and\s+(?={NUM}\s))"
ITEM = rf"(?is)^\s*(?:and\s+)?({NUM})\s+((?:{UNIT}\b|with\b|for\b|due\b|who\b|that\b|aged?\b|under\b|younger\b|older\b|no\b|without\b|having\b|because\b|from\b|in\b|at\b|by\b|as\b|based\b).{{0,180}})"
DISJOINT, EXHAUSTIVE = r"(?i)\b(?:mutually\s+exclusive|non[ -]?overlapping|disjoint)\b", r"(?i)\bexhaustive\b|\bexhaust(?:s|ed|ing)?\s+all\b"
REMAINDER = rf"(?i)\b(?:all|the)\s+remaining\s+{UNIT}\s+(?:were|was)\s+included\b"
SEQUENCE = r"(?is)\b(?:each\s+subsequent\s+exclusion|subsequent\s+exclusions?|sequentially\s+excluded|exclusions?\s+were\s+applied\s+sequentially)\b.{0,100}?\b(?:from|to|against)\s+(?:the\s+)?remaining\b"
DOUBT = r"(?i)\b(?:may|might|could|can)\s+(?:not\s+be\s+)?(?:overlap|disjoint)\b|\bnot\s+(?:necessarily\s+)?(?:disjoint|mutually\s+exclusive|non[ -]?overlapping|exhaustive)\b|\bneither\s+mutually\s+exclusive\b|\bnor\s+exhaustive\b|\badditional\s+exclusions?\s+(?:may|were|are)\b"
PARTITION = r"(?is)\b(?:exclusion\s+categories|exclusion\s+reasons|exclusions?|excluded\s+(?:groups?|categories?|sets?))\b.{0,100}?\b(?:mutually\s+exclusive|disjoint|non[ -]?overlapping)\b"
GROUP = r"(?i)\b([a-z][a-z0-9_-]*(?:\s+[a-z][a-z0-9_-]*){0,2})\s+(?:arm|group)\b"
GROUP_AFTER = r"(?i)\b(?:arm|group)\s+([a-z0-9_-]+)\b"
TIME = r"(?i)\b(baseline|follow[ -]?up|week\s+[0-9]{1,4}|month\s+[0-9]{1,4}|year\s+[0-9]{1,4})\b"
COHORT = r"(?i)\b(?:cohort|study\s+population|trial\s+population|study\s+cohort)\s+([A-Za-z0-9_-]+)\b"
MAX_FLOW_CHARS, MAX_EXCLUSIONS = 20_000, 32


def unit_of(text: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv))[F.lower(text)]


def named(text: Column, pattern: str) -> Column:
    """What a text names, each once, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1)), F.lower))


def groups(text: Column) -> Column:
    """Groups and arms that a text names, without articles."""
    found = F.concat(named(text, GROUP), named(F.regexp_replace(text, GROUP, " "), GROUP_AFTER))
    plain = F.transform(found, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"\b(?:the|study)\b", " "), r"\s+", " ")))
    return F.array_distinct(F.filter(plain, lambda x: x != ""))


def read_flows(df: DataFrame, text: str = "text") -> DataFrame:
    """Paragraphs that state a total, exclusions and who was included at last, read and checked.

    A paragraph without all three cues gives no row. Group, time and cohort that an operand names
    have to be the total's; what it doesn't name is taken over.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    cues = F.regexp_like(t, F.lit("(?i)" + TOTAL)) & F.regexp_like(t, F.lit("(?i)" + EXCLUDED)) & F.regexp_like(t, F.lit("(?i)" + INCLUDED))
    g = lambda k: F.regexp_extract(t, WHOLE, k)
    rows = df.where(cues).withColumns({
        "ordered": F.regexp_like(t, F.lit(WHOLE)), "total": to_count(g(1)), "total_said": F.concat(g(2), g(4)), "total_unit": unit_of(g(3)), "middle": g(5),
        "included": to_count(g(6)), "included_said": g(7), "included_unit": unit_of(g(8)),
    })
    pieces = F.filter(F.split("middle", BETWEEN), lambda x: F.regexp_like(x, F.lit(ITEM)))
    # An exclusion ends with its sentence; what follows is about their relation.
    items = F.transform(pieces, lambda x: F.struct(to_count(F.regexp_extract(x, ITEM, 1)).alias("n"), F.regexp_replace(F.regexp_extract(x, ITEM, 2), r"(?s)[.;](?:\s.*)?$", "").alias("said"), unit_of(F.regexp_extract(x, ITEM, 3)).alias("unit")))
    rows = rows.withColumn("items", items).withColumn("exclusions", F.transform("items", lambda x: x["n"]))

    def differs(said: Column) -> Column:
        out = F.lit(False)
        for read in (groups, lambda x: named(x, TIME), lambda x: named(x, COHORT)):
            mine = read(said)
            out = out | ((F.size(mine) > 0) & (mine != read(F.col("total_said"))))
        return out

    times = lambda x: named(x, TIME)
    several = lambda c, read: F.size(read(F.col(c))) > 1
    middle = F.col("middle")
    has = lambda p: F.regexp_like(middle, F.lit(p))
    bad = lambda c: ~F.coalesce(c.between(0, MAX_COUNT), F.lit(False))
    reason = (
        F.when(F.length(t) > MAX_FLOW_CHARS, "FLOW_PARAGRAPH_EXCEEDS_LIMIT")
        .when(~F.col("ordered"), "FLOW_OPERAND_ORDER_UNSUPPORTED")
        .when(bad(F.col("total")) | bad(F.col("included")), "FLOW_COUNT_OUT_OF_BOUNDS")
        .when(F.size("items") < 2, "FLOW_NEEDS_TWO_EXCLUSIONS")
        .when(F.size("items") > MAX_EXCLUSIONS, "FLOW_EXCLUSION_LIMIT")
        .when(several("total_said", groups) | several("included_said", groups), "FLOW_GROUP_SCOPE_AMBIGUOUS")
        .when(several("total_said", times) | several("included_said", times), "FLOW_TIMEPOINT_SCOPE_AMBIGUOUS")
        .when(F.exists("exclusions", bad), "FLOW_COUNT_OUT_OF_BOUNDS")
        .when((F.col("total_unit") != F.col("included_unit")) | F.exists("items", lambda x: F.coalesce(x["unit"] != F.col("total_unit"), F.lit(False))), "FLOW_OPERAND_UNIT_MISMATCH")
        .when(differs(F.col("included_said")) | F.exists("items", lambda x: differs(x["said"])), "FLOW_OPERAND_SCOPE_MISMATCH")
        .when(has(DOUBT), "FLOW_RELATION_CUE_CONFLICT")
        .when(~((has(DISJOINT) & has(EXHAUSTIVE) & has(REMAINDER) & has(PARTITION)) | (has(SEQUENCE) & has(REMAINDER))), "FLOW_DISJOINTNESS_EXHAUSTIVENESS_OR_SEQUENCE_NOT_EXPLICIT")
    )
    rows = rows.withColumn("reason", reason)
    free = F.col("reason").isNull()
    expected = F.when(free, F.col("total") - F.aggregate("exclusions", F.lit(0).cast("bigint"), lambda a, x: a + x))
    ambiguous = F.col("reason").isin("FLOW_RELATION_CUE_CONFLICT", "FLOW_DISJOINTNESS_EXHAUSTIVENESS_OR_SEQUENCE_NOT_EXPLICIT")
    status = F.when(ambiguous, "FLOW_RELATION_AMBIGUOUS").when(~free, "UNSUPPORTED").when(expected == F.col("included"), "FLOW_BALANCED").otherwise("FLOW_ARITHMETIC_CANDIDATE")
    return rows.withColumns({"expected": expected, "status": status}).drop("ordered", "total_said", "middle", "included_said", "items")
