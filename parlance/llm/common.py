"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for tables that cut lineage: ``spark.checkpoint.dir``.

    Only where a local session names none (tests) is a temporary folder made; on a cluster,
    where executors would not share it, that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="parlance-scratch-")
        atexit.register(shutil.rmtree, _LOCAL_ROOTS[app], ignore_errors=True)
    return "file://" + _LOCAL_ROOTS[app]


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/parlance/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The result has no lineage to recompute, so a lost executor costs only the
    tasks that it was running.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the files of materialized tables that nothing reads any more."""
    for df in frames:
        jvm = df.sparkSession._jvm
        conf = df.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def pick(docs: DataFrame, **cols: str) -> DataFrame:
    """Project ``docs`` to the named columns only, so that no other column can clash."""
    return docs.select(*[docs[f"`{src}`"].alias(dst) for dst, src in cols.items()])


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names made from ``names`` that no column of ``docs`` has, in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_key(id_: Column, text_key: Column) -> Column:
    """A 64-bit name of a row with this id (null included) and text hash."""
    return F.xxhash64(id_.isNull(), id_, text_key)


ROWS_CONF, BYTES_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, rows: int = 500, size: int = 4 << 20) -> None:
    """Bound what goes to a Python worker at once; the default of 10,000 rows is too much for long texts.

    The bound stays in the session, as a result that is read later still sends texts to workers.
    """
    spark.conf.set(ROWS_CONF, str(rows))
    spark.conf.set(BYTES_CONF, str(size))


@contextmanager
def arrow_batches(spark: SparkSession, rows: int, size: int = 4 << 20) -> Iterator[None]:
    """Larger batches for the small rows that are written inside the block; afterwards the session is as before."""
    before = {c: spark.conf.get(c) for c in (ROWS_CONF, BYTES_CONF)}
    bound_batches(spark, rows, size)
    try:
        yield
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
