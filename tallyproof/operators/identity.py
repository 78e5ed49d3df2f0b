"""Records of one work merged over shared identifiers, with vetoes.

Spark finds the coarse components over shared identifiers; inside one, links are taken in order of
the identifier's rank, and one is refused that would join two DOIs, or a record without DOI that
other identifiers tie to several.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyproof.operators.lineage import normalize_doi, normalize_pmcid
from tallyproof.sources.shared import ship_code, written

KINDS = ("doi", "pmcid", "pmid")


def normalized(df: DataFrame) -> DataFrame:
    pmid = F.when(F.regexp_like(F.coalesce("pmid", F.lit("")), F.lit("^[0-9]+$")), F.col("pmid"))
    return df.select("candidate_id", normalize_doi(F.col("doi")).alias("doi"), normalize_pmcid(F.col("pmcid")).alias("pmcid"), pmid.alias("pmid"))


def components(pairs: DataFrame) -> DataFrame:
    """(id, comp): the least string id reachable over edges (a, b), by taking neighbours' labels and then the labels' own until none changes, so rounds grow with the logarithm of a chain's length."""
    both = pairs.select("a", "b").union(pairs.select("b", "a")).distinct()
    both = written(both)
    label = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")))
    while True:
        near = both.join(label.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("m"))
        least = label.join(near, "id").select("id", "comp", F.least("comp", "m").alias("least"))
        up = label.select(F.col("id").alias("least"), F.col("comp").alias("up"))
        lower = F.coalesce("up", "least")
        new = written(least.join(up, "least", "left").select("id", lower.alias("comp"), (lower < F.col("comp")).alias("moved")))
        if not new.where("moved").limit(1).count():
            return label
        label = new.select("id", "comp")


def merge_group(rows: list[tuple]) -> tuple[dict[str, str], list[tuple[str, str, str]]]:
    """(group of each id, refused links) of the records (id, doi, pmcid, pmid) of one component."""
    rows = sorted(rows)
    ids = [dict(zip(KINDS, r[1:], strict=True)) for r in rows]
    holders: dict[tuple[int, str], list[int]] = {}
    for i, x in enumerate(ids):
        for rank, k in enumerate(KINDS):
            if x[k]:
                holders.setdefault((rank, x[k]), []).append(i)
    dois_of = {key: {ids[i]["doi"] for i in members} for key, members in holders.items()}
    known = lambda x: set().union(*(dois_of[rank, x[k]] for rank, k in enumerate(KINDS) if rank and x[k])) - {None}
    tied = [not x["doi"] and len(known(x)) > 1 for x in ids]
    # Of each record its group: members, their DOIs, whether one of them is tied.
    group = {i: ({i}, {x["doi"]} - {None}, [tied[i]]) for i, x in enumerate(ids)}
    refused, links = [], set()
    for (rank, _), members in holders.items():
        # Holders of one DOI can't be refused to each other: a star ties them. Others are compared each with each.
        dois = dois_of[rank, ids[members[0]][KINDS[rank]]]
        star = len(dois) == 1 and None not in dois
        for n, i in enumerate(members[:1] if star else members):
            for j in members[n + 1 :]:
                # A link counts by the first identifier that two records share.
                if not any(ids[i][k] and ids[i][k] == ids[j][k] for k in KINDS[:rank]):
                    links.add((rank, i, j))
    for _, i, j in sorted(links):
        if group[i] is group[j]:
            continue
        (_, dois_i, unsure_i), (_, dois_j, unsure_j) = group[i], group[j]
        if dois_i and dois_j and dois_i != dois_j:
            refused.append((rows[i][0], rows[j][0], "conflicting_doi"))
        elif (unsure_i[0] and dois_j) or (unsure_j[0] and dois_i):
            refused.append((rows[i][0], rows[j][0], "ambiguous_identifier_overlap"))
        else:
            small, large = sorted((group[i], group[j]), key=lambda g: len(g[0]))
            large[0].update(small[0])
            large[1].update(small[1])
            large[2][0] |= small[2][0]
            for k in small[0]:
                group[k] = large
    least = {id(g): min(g[0]) for g in {id(g): g for g in group.values()}.values()}
    return {rows[i][0]: rows[least[id(group[i])]][0] for i in group}, refused


def merge(candidates: DataFrame) -> DataFrame:
    """(candidate_id, group_id, unresolved): unresolved lists refused links as reason:id."""
    rows = normalized(candidates)
    keyed = rows.select("candidate_id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in KINDS))).alias("x")).where("x.value is not null")
    first = keyed.withColumn("b", F.min("candidate_id").over(Window.partitionBy("x.kind", "x.value")))
    comp = components(first.where("candidate_id <> b").select(F.col("candidate_id").alias("a"), "b"))
    placed = rows.join(comp.withColumnRenamed("id", "candidate_id"), "candidate_id", "left").withColumn("comp", F.coalesce("comp", "candidate_id"))

    def run(table):
        records = list(zip(*(table.column(c).to_pylist() for c in ("candidate_id", *KINDS)), strict=True))
        groups, refused = merge_group(records)
        notes: dict[str, list[str]] = {i: [] for i in groups}
        for a, b, why in refused:
            notes[a].append(f"{why}:{b}")
            notes[b].append(f"{why}:{a}")
        return pa.table({"candidate_id": list(groups), "group_id": list(groups.values()), "unresolved": pa.array([sorted(notes[i]) for i in groups], pa.list_(pa.string()))})

    ship_code(placed.sparkSession)
    return placed.groupBy("comp").applyInArrow(run, "candidate_id string, group_id string, unresolved array<string>")
