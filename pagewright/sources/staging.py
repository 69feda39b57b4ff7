"""Tables written between the steps of a query, in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_STAGED: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where none is set, a folder of this machine, but only for a session that has no other machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="pagewright-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: a cut of the lineage that outlives executors, for what is used twice.

    The write is a job of its own, as the plan that reads it needs the table; it is deleted when the program ends.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _STAGED:
        atexit.register(drop_staged)
    _STAGED.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged() -> None:
    """Deletes what this program has staged; results that still read from it are lost."""
    while _STAGED:
        spark, path = _STAGED.pop()
        try:
            jvm = spark._jvm
            jvm.org.apache.hadoop.fs.FileSystem.get(jvm.java.net.URI(path), jvm.org.apache.hadoop.conf.Configuration()).delete(jvm.org.apache.hadoop.fs.Path(path), True)
        except Exception:  # the JVM has gone; whoever owns the folder empties it
            return
