"""Tables in the shared folder, to cut lineage without losing fault tolerance.

``spark.checkpoint.dir`` names a folder that the driver and all executors
share.  A table written there survives the loss of any executor, unlike a
cached or locally checkpointed one.
"""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


@functools.cache
def _own(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="skein-")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a folder of this process, in local mode only (tests)."""
    base = spark.conf.get(_KEY, None)
    if not base:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError(f"set {_KEY} to a folder that the driver and all executors share")
        base = _own(context.applicationId)
    return base.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back: evaluated once, no lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skein/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._skein_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of :func:`written` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_skein_path", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
