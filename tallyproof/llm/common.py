"""What the operators of this subpackage share: column picking, Arrow batches, word splitting."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one Arrow batch sent to Python: some texts are very long, so batches stay small.
BATCH_ROWS = 256
#: Stands for a null doc_id where documents have an order: after all others.
LAST_DOC = 2**63 - 1


class Recent:
    """A bounded mapping in two generations: when the young one is full, it becomes the old one."""

    def __init__(self, size: int):
        self.size = size
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value

    def __len__(self) -> int:
        return len(self.young) + len(self.old)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship_code(spark: SparkSession) -> None:
    """Let Python workers import this package where it lies at the same path as on the driver."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def docs_of(df: DataFrame, key: str = "doc_id", text: str = "text", binary: bool = True) -> DataFrame:
    """The key (bigint) and text columns only, so that no other column of the input can clash with a result.

    binary: the text as its UTF-8 bytes, which Python then gets without decoding.
    """
    kind = "binary" if binary else "string"
    return df.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").cast(kind).alias("text"))


def release() -> None:
    """Give memory that this worker has freed back to the system: workers wait for other stages beside the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # a system without it keeps the pages


def map_rows(df: DataFrame, fn: Callable[[], Callable], schema: str | T.StructType) -> DataFrame:
    """Rows through a Python function by Arrow batches.

    fn() is called once a task and returns a function from the lists of the input columns to the
    lists of the output columns. Batches of any size are cut to BATCH_ROWS, so memory follows the
    longest few texts and not the partition.
    """
    names = df.columns
    to = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    ship_code(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(to)
        work = fn()
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                out = work(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values, type=field.type) for values, field in zip(out, arrow, strict=True)], schema=arrow
                )
        release()

    return df.mapInArrow(run, to)


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share.

    It lies in the folder that the cluster names in spark.checkpoint.dir. Where none is named, one
    machine takes a temporary folder; a cluster is refused, since its machines share none.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base and sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        base = tempfile.mkdtemp(prefix="tallyproof-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    if not base:
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    return f"{base.rstrip('/')}/tallyproof-{uuid.uuid4().hex}"


def cut(df: DataFrame, at: list[str] | None = None) -> DataFrame:
    """Write the rows once to the shared folder and go on from the written table; at gets its path."""
    where = shared_folder(df.sparkSession)
    df.write.parquet(where)
    if at is not None:
        at.append(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def drop_cut(spark: SparkSession, at: list[str]) -> None:
    """Delete written tables that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while at:
        path = jvm.org.apache.hadoop.fs.Path(at.pop())
        path.getFileSystem(conf).delete(path, True)
