"""Tables written to the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


#: Folders of our own: the innermost open scope, and below it the one of a local session without a setting.
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or the scope opened in it. Where that is unset, one of our own in local
    mode, which has one machine; an error elsewhere."""
    if not _own:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path:
            return path.rstrip("/")
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _own.append(tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp"))
    return _own[-1]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: what was computed once stays as it is."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder of its own for what is written inside; deleted at the end. Results must be read or saved before."""
    path = new_path(spark, "scratch")
    _own.append(path)
    try:
        yield path
    finally:
        _own.remove(path)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
