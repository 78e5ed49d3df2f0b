"""Review bundles as tables: relations, status and a manifest of hashes, written once and replayed by recomputation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = ("relations", "status")


def row_hash(df: DataFrame) -> DataFrame:
    """SHA-256 of each row as JSON of its columns in order of name."""
    return df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256).alias("h"))


def digest(df: DataFrame) -> tuple[int, str]:
    """Number of rows and an order-free digest: the sum of the row hashes' leading 120 bits and the least and greatest hash."""
    parts = row_hash(df).agg(
        F.count("*").alias("n"), F.sum(F.conv(F.substring("h", 1, 15), 16, 10).cast("decimal(38,0)")).alias("s"),
        F.sum(F.conv(F.substring("h", 16, 15), 16, 10).cast("decimal(38,0)")).alias("t"), F.min("h").alias("lo"), F.max("h").alias("hi"),
    ).first()
    return parts.n, f"{parts.s}:{parts.t}:{parts.lo}:{parts.hi}"


def write_bundle(spark: SparkSession, path: str, **parts: DataFrame) -> DataFrame:
    """Write each part once (an existing bundle is an error) and the manifest beside them."""
    rows = []
    for name, df in sorted(parts.items()):
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
        rows.append((name, *digest(spark.read.parquet(f"{path}/{name}"))))
    manifest = spark.createDataFrame(rows, "name string, rows bigint, digest string")
    manifest.coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")
    return manifest


def replay(spark: SparkSession, path: str, **parts: DataFrame) -> DataFrame:
    """Recomputed parts against a bundle: stored, manifest and fresh digests, and whether all agree."""
    said = {r.name: (r.rows, r.digest) for r in spark.read.schema("name string, rows bigint, digest string").json(f"{path}/manifest").collect()}
    rows = []
    for name, df in sorted(parts.items()):
        stored, fresh = digest(spark.read.parquet(f"{path}/{name}")), digest(df)
        rows.append((name, stored == said.get(name), fresh == stored))
    return spark.createDataFrame(rows, "name string, intact boolean, reproduced boolean")
