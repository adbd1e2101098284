"""Session helpers of the training-data operators: the shared folder and tables written into it.

Everything is written below a folder of the application, so that what results still need can stay until ``clear`` is called
or the application has ended, and the folders of ended applications can be deleted as a whole.
"""

from __future__ import annotations

import contextlib
import getpass
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


_made: list[str] = []  # paths of this process's tables


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process; those of ``local-cluster`` aren't."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a folder of this machine (tests, benchmarks); a cluster
    without it is an error, since executors would not see each other's files.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not is_local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{os.path.join(tempfile.gettempdir(), f'fernstore-{getpass.getuser()}')}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call has got."""
    _made.append(f"{shared_dir(spark)}/llm-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that were written within it."""
    start = len(_made)
    yield
    for path in _made[start:]:
        dropped(spark, path)
    del _made[start:]


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has written; no result that isn't collected or saved may be used any more."""
    dropped(spark, f"{shared_dir(spark)}/llm-{spark.sparkContext.applicationId}")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: its lineage ends there.

    Later stages re-read the files if executors are lost. A table costs disk until ``forget`` or ``clear``.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the table that ``written`` has made for ``df``, once nothing lazy needs it any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        dropped(spark, folder)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that no DataFrame needs any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
