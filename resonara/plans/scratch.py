"""Reliable lineage cuts.

Iterative operators cut their lineage by writing to the folder all executors
share.  The folder is the one the cluster names in ``spark.checkpoint.dir``;
only where that is unset and Spark runs on one machine (tests, notebooks) is a
folder of this machine set; elsewhere its absence is an error.

What is written here is deleted when the JVM ends, whether or not the session was
stopped before, and earlier where a caller says that it has what it needs
(``releasing``).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def _system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete_at_end(spark: SparkSession, path: str) -> None:
    target, system = _system(spark, path)
    system.mkdirs(target)  # only what is there can be marked
    system.deleteOnExit(target)


def new_folder(spark: SparkSession, label: str) -> str:
    """A new name in the shared folder; what is written there is deleted at the end."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _delete_at_end(spark, path)
    _written.append(path)
    return f"{path}/data"


@contextmanager
def releasing(spark: SparkSession) -> Iterator[list[str]]:
    """Delete what is written meanwhile, but for the folders that are put into the list."""
    before, keep = len(_written), []
    try:
        yield keep
    finally:
        mine = _written[before:]
        _written[before:] = [p for p in mine if p in keep]
        for path in mine:
            if path not in keep:
                target, system = _system(spark, path)
                system.delete(target, True)


def last_folder() -> str:
    """The folder that was named last, for ``releasing``."""
    return _written[-1]


def shared_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; sets one of our own only where none is set."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if not named:
        current = context.getCheckpointDir()
        if current is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            made = tempfile.mkdtemp(prefix="resonara-")
            context.setCheckpointDir(made)
            _delete_at_end(spark, made)
            current = context.getCheckpointDir()
        return current
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` without its lineage, written in the shared folder."""
    return kept(df, "cut")


def kept(df: DataFrame, label: str = "table") -> DataFrame:
    """``df`` as a Parquet table in the shared folder; the plan above knows nothing of the one below."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
