"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Every number comes from Spark's own string and array functions, so the whole operator is one
projection over the scan: no shuffle, no Python. Memory of a task follows its longest text.

Defined results: a null or blank text has no words, so all counts are 0 and it is rejected; ties
and repeated rows are judged each on its own; an empty table gives an empty result; columns of the
input other than the key and the text are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in that is was for with as on it at by from are this be or "
    "der die und das den zu mit von ist für auf ein eine nicht im dem des sich als auch "
    "le la les des et du une un est pour dans que qui sur au par pas il en ce "
    "el los las que y del se por con una para no al lo su es de"
).split()


@dataclass(frozen=True)
class Rule:
    """name: said in failed_rules; metric: a column of metrics(); keep where low <= metric <= high."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Ratios are per word or per line; None leaves a side open.
RULES = (
    Rule("length", "n_words", low=50),
    Rule("word_length", "mean_word_chars", low=2.0, high=16.0),
    Rule("symbols", "symbol_ratio", high=0.10),
    Rule("stop_words", "stop_ratio", low=0.01),
    Rule("repeated_lines", "dup_line_ratio", high=0.50),
    Rule("repeated_words", "repeat_ratio", high=0.50),
)


def bound(value: Column, body) -> Column:
    """body(x) with x the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text, the first finding included.

    Windows are sorted with their places; equal neighbours are the repeated ones; then the places
    that these cover are summed, each window adding at most its distance to the one before.
    """
    windows = F.when(
        F.size(words) >= 3,
        F.sort_array(
            F.transform(
                F.sequence(F.lit(0), F.size(words) - 3),
                lambda i: F.struct(
                    F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")
                ),
            )
        ),
    ).otherwise(F.array().cast("array<struct<w:string,i:int>>"))

    def starts(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["w"] == x["w"], F.lit(False))
        found = F.filter(s, lambda x, k: same(x, k + 1) | ((k > 0) & same(x, F.greatest(k - 1, F.lit(0)))))
        return F.sort_array(F.transform(found, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.when(
            F.size(p) > 0,
            F.aggregate(
                p,
                F.struct(F.lit(0).alias("sum"), F.lit(-3).alias("last")),
                lambda acc, x: F.struct(
                    (acc["sum"] + F.least(F.lit(3), x - acc["last"])).alias("sum"), x.alias("last")
                ),
                lambda acc: acc["sum"],
            ),
        ).otherwise(F.lit(0))

    return bound(bound(windows, starts), covered)


def metrics(df: DataFrame, key: str = "doc_id", text: str = "text", carry: list[Column] | None = None) -> DataFrame:
    """doc_id, the counts and ratios that rules may name, and carried columns as one struct (row)."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = df.select(F.col(key).alias("doc_id"), t.alias("text"), F.struct(*(carry or [F.lit(0)])).alias("row"))
    split = base.select("doc_id", "row", "text", words_of(F.col("text")).alias("words"), F.split("text", "\n").alias("lines"))
    full = F.filter("lines", lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    counted = split.select(
        "doc_id",
        "row",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")).cast("bigint").alias("n_symbols"),
        bound(full, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))).alias("l"),
        repeated_words(F.col("words")).cast("bigint").alias("n_repeat_words"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).alias("n_stop"),
    )
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    return counted.select(
        "doc_id",
        "row",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.col("l.n") - F.col("l.d")).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words",
        per_word("word_chars").alias("mean_word_chars"),
        per_word("n_symbols").alias("symbol_ratio"),
        per_word("n_stop").alias("stop_ratio"),
        per_word("n_repeat_words").alias("repeat_ratio"),
        ((F.col("l.n") - F.col("l.d")) / F.greatest(F.col("l.n"), F.lit(1))).alias("dup_line_ratio"),
    )


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a row of metrics() breaks, in the table's order."""
    broken = []
    for r in rules:
        x = F.col(r.metric)
        low = x < F.lit(r.low) if r.low is not None else F.lit(False)
        high = x > F.lit(r.high) if r.high is not None else F.lit(False)
        broken.append(F.when(low | high, F.lit(r.name)))
    return F.array_compact(F.array(*broken))


def judge(
    df: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text", carry: list[Column] | None = None
) -> DataFrame:
    """metrics() with base_failed, failed_rules and kept."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        metrics(df, key, text, carry)
        .withColumn("base_failed", base)
        .withColumn("failed_rules", compile_rules(rules))
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    )


def kept_rows(df: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df, all its columns, that the rules keep; each row is judged where it lies, without a join.

    A filter would be pushed below the projection, with a copy of every expression in it, each
    computed again at every use; a generator of one row or none isn't.
    """
    judged = judge(df, rules, key, text, [F.col(c) for c in df.columns])
    return judged.select(F.explode(F.when(F.col("kept"), F.array("row"))).alias("row")).select("row.*")
