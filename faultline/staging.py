"""Tables written once in the shared checkpoint folder.

A staged table cuts lineage and survives the loss of any executor, and, unlike an RDD
checkpoint, it keeps column pruning and file statistics, so joins on it can be planned from
its real size.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CHECKPOINT_CONF = "spark.checkpoint.dir"
_local_dirs: dict[str, str] = {}
_job_folder: ContextVar[str | None] = ContextVar("job_folder", default=None)

# A side goes to every executor only below this measured size.
BROADCAST_BYTES = 64 << 20


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder from the session; a temporary one only on a local master."""
    root = spark.conf.get(_CHECKPOINT_CONF, None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {_CHECKPOINT_CONF} to a folder that all executors share")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="faultline-")
    return _local_dirs[context.applicationId]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path not used before, below the folder of the running job if there is one."""
    parent = _job_folder.get() or f"{checkpoint_root(spark)}/{spark.sparkContext.applicationId}"
    return f"{parent}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, measured: bool = False) -> DataFrame:
    """Write ``df`` as parquet below the checkpoint folder and read it back.

    With ``measured`` its bytes are counted while it is written, and ``fits_broadcast`` of the
    result needs no job.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    taken = Observation()
    written = df.observe(taken, _size(df).alias("bytes")) if measured else df
    written.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    if measured:
        staged._measured_bytes = taken.get["bytes"] or 0
    return staged


@contextmanager
def job_staging(spark: SparkSession) -> Iterator[None]:
    """Drop what is staged inside the block when it ends, for jobs that save their results."""
    folder = new_folder(spark, "job")
    token = _job_folder.set(folder)
    try:
        yield
    finally:
        _job_folder.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fits_broadcast(df: DataFrame) -> bool:
    """Is a would-be broadcast side small? It should be a staged table.

    One that was measured when it was written tells at once; any other is measured by a job.
    """
    measured = getattr(df, "_measured_bytes", None)
    if measured is None:
        measured = df.agg(_size(df).alias("bytes")).first()["bytes"] or 0
    return measured <= BROADCAST_BYTES


def _size(df: DataFrame) -> Column:
    return F.sum(reduce(add, map(_width, df.schema.fields)))


def _width(field: T.StructField) -> Column:
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        width = F.octet_length(field.name)
    elif isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
        width = F.octet_length(F.to_json(F.struct(field.name)))
    else:
        width = F.lit(8)
    return F.coalesce(width, F.lit(0)).cast("bigint") + F.lit(8)
