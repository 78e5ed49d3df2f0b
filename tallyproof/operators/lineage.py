"""Hash-chained event streams, parent pointers, identities and byte reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyproof.sources.shared import written


def event_hash(*columns: str) -> Column:
    """SHA-256 of the columns' text, joined by a bar, nulls as nothing."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)


def chain(events: DataFrame, by: str, order: list[str], columns: list[str]) -> DataFrame:
    """Each event with its place in its stream, its hash and that of the one before."""
    w = Window.partitionBy(by).orderBy(*order)
    rows = events.withColumn("hash", event_hash(*columns))
    return rows.withColumn("seq", F.row_number().over(w)).withColumn("previous", F.lag("hash").over(w))


def chain_breaks(events: DataFrame, by: str = "stream", seq: str = "seq", digest: str = "hash", previous: str = "previous_sha256") -> DataFrame:
    """Events whose recorded previous hash isn't that of the event before, or whose number doesn't follow it."""
    w = Window.partitionBy(by).orderBy(seq)
    rows = events.withColumn("want", F.lag(digest).over(w)).withColumn("place", F.row_number().over(w))
    return rows.where(~F.col(previous).eqNullSafe(F.col("want")) | (F.col(seq) != F.col("place"))).drop("want", "place")


def fold(events: DataFrame, by: str, order: list[str], kind: str, set_kinds: list[str], clear_kinds: list[str]) -> DataFrame:
    """State of each stream after its last event: the last setting event holds unless a clearing one came after."""
    setting, clearing = F.col(kind).isin(set_kinds), F.col(kind).isin(clear_kinds)
    at = F.struct(*order)
    rows = events.groupBy(by).agg(
        F.count("*").alias("events"),
        F.max(F.when(setting, at)).alias("set_at"),
        F.max(F.when(clearing, at)).alias("cleared_at"),
        F.max_by(kind, at).alias("last_kind"),
    )
    state = (
        F.when(F.col("set_at").isNull(), F.lit("never_set"))
        .when(F.col("cleared_at").isNull() | (F.col("cleared_at") < F.col("set_at")), F.lit("set"))
        .otherwise(F.lit("cleared"))
    )
    return rows.withColumn("state", state).drop("set_at", "cleared_at")


def carry_forward(rows: DataFrame, by: str, order: list[str], marker: Column, value: str) -> DataFrame:
    """Each row with its last marker's value, and how many markers came so far."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("group_value", F.last(F.when(marker, F.col(value)), True).over(w)).withColumn(
        "group_number", F.sum(F.when(marker, 1).otherwise(0)).over(w)
    )


def byte_reuse(rows: DataFrame, content: str, owner: str) -> DataFrame:
    """Content that several owners hold, by its hash."""
    hashed = rows.select(F.sha2(content, 256).alias("sha256"), owner)
    return hashed.groupBy("sha256").agg(F.count("*").alias("copies"), F.countDistinct(owner).alias("owners")).where("copies > 1")


def normalize_host(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def normalize_path(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def normalize_doi(text: Column) -> Column:
    """Lower case, without resolver address or doi: in front; null where no DOI is left."""
    bare = F.regexp_replace(F.lower(F.trim(text)), r"^(https?://(dx\.)?doi\.org/|doi:\s*)", "")
    return F.when(F.regexp_like(bare, F.lit(r"^10\.[0-9]{4,9}/\S+$")), bare)


def normalize_pmcid(text: Column) -> Column:
    digits = F.regexp_extract(F.upper(F.trim(text)), r"^(?:PMC)?([0-9]+)$", 1)
    return F.when(digits != "", F.concat(F.lit("PMC"), digits))


def work_key(doi: Column, pmcid: Column, pmid: Column) -> Column:
    """The first identifier there is, by rank, with its kind."""
    return F.coalesce(
        F.concat(F.lit("doi:"), normalize_doi(doi)), F.concat(F.lit("pmcid:"), normalize_pmcid(pmcid)), F.concat(F.lit("pmid:"), F.trim(pmid))
    )


def steps(pointers: DataFrame) -> DataFrame:
    """(id, up, far): the pointers of (id, up) doubled until each has reached a root or has gone further than there are pointers; up is null at a root.

    A chain of n records takes log2(n) rounds, so no length is too long; what is still going then is
    in a cycle, or leads into one.
    """
    jump = written(pointers.select("id", "up"))
    n, far = jump.count(), 1
    while far <= n and jump.where("up is not null").limit(1).count():
        above = jump.select(F.col("id").alias("up"), F.col("up").alias("next"))
        jump = written(jump.join(above, "up", "left").select("id", F.col("next").alias("up")))
        far *= 2
    return jump


def in_cycles(pointers: DataFrame) -> DataFrame:
    """The ids of (id, up) that are in a cycle or lead into one."""
    return steps(pointers).where("up is not null").select("id")


def cycle_lengths(pointers: DataFrame) -> DataFrame:
    """(id, cycle_length): how many steps lead an id back to itself, null where none do.

    An id is in a cycle if doubled pointers lead to it; the cycle's least id is found by doubling
    again, and its size is that of the group.
    """
    all_ids = pointers.select("id")
    inside = written(steps(pointers).where("up is not null").select(F.col("up").alias("id")).distinct())
    now = written(pointers.join(inside, "id").select("id", "up", F.least("id", "up").alias("low")))
    n, far = now.count(), 1
    while far <= n:
        above = now.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("low").alias("low2"))
        now = written(now.join(above, "up").select("id", F.col("next").alias("up"), F.least("low", "low2").alias("low")))
        far *= 2
    size = now.groupBy("low").agg(F.count("*").alias("cycle_length"))
    return all_ids.join(now.join(size, "low").select("id", "cycle_length"), "id", "left")


def distinct_captures(captures: DataFrame, key: str) -> DataFrame:
    """(sha256, first_id, copies): captures of equal bytes are one, the least key stands for it."""
    return captures.groupBy("sha256").agg(F.min(key).alias("first_id"), F.count("*").alias("copies"))
