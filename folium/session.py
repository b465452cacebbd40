"""Session plumbing: table access, checkpoints, and shipping the package to executors."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table (a file or a folder of part files) of a dataset folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; set a local one only where none is named and all is one machine."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="folium-checkpoint-"))


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint: computed once, readable after an executor is lost."""
    global _calls
    ensure_checkpoint_dir(df.sparkSession)
    _calls += 1
    if _calls % SWEEP == 0:
        sweep(df.sparkSession)
    return df.checkpoint(eager=True)


#: Checkpoints after which what earlier steps left on disk is let go.
SWEEP = 6
_calls = 0


def sweep(spark: SparkSession) -> None:
    """Let Spark remove shuffle files, and checkpoints where so configured, that no table needs any more.

    It does so once the driver has collected its garbage, which may be half an hour off in a driver that has
    little to do; operators of many steps would fill the disks until then.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settled(df: DataFrame) -> DataFrame:
    """``materialize`` for what a loop carries on: the planner's guess of its size is forgotten as well.

    A checkpoint keeps the guess, a join multiplies those of its sides, and over a few rounds they grow
    to numbers of so many digits that planning never ends.  Spark's own entry for rows that are there
    already makes a table without a guess; where it is missing, the checkpoint is used as it is.
    """
    done = materialize(df)
    spark = done.sparkSession
    try:
        return DataFrame(spark._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False), spark)
    except (AttributeError, TypeError):
        return done


def shared_folder(spark: SparkSession) -> str:
    """A new folder name that the driver and all executors share, beside the checkpoints."""
    ensure_checkpoint_dir(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/tables-{uuid.uuid4().hex}"


@contextlib.contextmanager
def removed(spark: SparkSession, folder: str) -> Iterator[str]:
    """A folder that is deleted, wherever it lies, when the block ends or fails."""
    try:
        yield folder
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a batch between the JVM and Python where the session has the default: texts may be long.
BATCH_ROWS = 1_000


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors once per application, so Python stages can import it.

    Batches are made smaller unless the session has set their size: ten thousand texts, or pairs of
    sets, would be held several times over by the JVM, by Arrow and by Python.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    handle, path = tempfile.mkstemp(prefix="folium-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w") as bundle:
        for source in sorted(root.rglob("*.py")):
            bundle.write(source, Path(root.name) / source.relative_to(root))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def tidy() -> None:
    """Give what this Python process no longer needs back to the system: idle workers keep their memory else."""
    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def released(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A function for mapInPandas whose worker gives its memory back when a partition ends."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            tidy()

    return wrapped
