"""Tables that cut lineage, written to the folder that every executor shares.

A lost executor then costs a re-read, never a recomputation of the whole plan. The folder is the
session's ``spark.checkpoint.dir``, or else what ``setCheckpointDir`` named. Where both are unset, a
local master (tests on one machine) gets a temporary folder, made once per process and removed at
exit; any other master is refused, as its executors don't see each other's disks.

``temporary`` deletes what was written inside it as soon as it ends, but for the tables that a lazy
result still reads.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_open = threading.local()


def shared_root(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = named.get() if named.isDefined() else None
    if base:
        return base.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="hapforge-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


class Scope:
    """The scratch paths taken inside one ``temporary`` block, and those that outlive it."""

    def __init__(self):
        self.paths: list[str] = []
        self.kept: set[str] = set()

    def keep(self, *tables: DataFrame) -> None:
        """Tables returned by ``materialize`` that are read after the block."""
        self.kept |= {t.__dict__["_scratch"] for t in tables}


def _scopes() -> list[Scope]:
    if not hasattr(_open, "scopes"):
        _open.scopes = []
    return _open.scopes


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Scope]:
    """What is written inside goes when the block ends; what ``keep`` named passes to the block around it, if any."""
    scope, scopes = Scope(), _scopes()
    scopes.append(scope)
    try:
        yield scope
    finally:
        scopes.remove(scope)
        for path in scope.paths:
            if path not in scope.kept:
                discard(spark, path)
            elif scopes:
                scopes[-1].paths.append(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path nobody has used before, below the shared folder."""
    path = f"{shared_root(spark)}/hapforge/{name}-{uuid.uuid4().hex}"
    if scopes := _scopes():
        scopes[-1].paths.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_scratch"] = path
    return out


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through the file system that holds it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
