"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

# Settings that belong to the job, not to the cluster. Executor sizes, shuffle
# partitions and the checkpoint folder come from the cluster's own configuration.
JOB_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # No call-site capture on every column expression: it costs more than the planning itself.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(app: str = "threadlens", cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in JOB_SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_made: list[str] = []  # paths handed out by new_path and not cleared yet


@cache
def _local_folder() -> str:
    """For a local session without a checkpoint folder, as in tests; it goes when Python ends."""
    folder = tempfile.mkdtemp(prefix="threadlens-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session, where driver and executors are one process, may do without.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _local_folder()


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; ``clear_paths`` removes what was written there."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex[:12]}"
    _made.append(path)
    return path


def clear_paths(spark: SparkSession) -> None:
    """Remove the intermediate tables of this process. For the end of a job: tables read from them are gone, too."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(hadoop).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing ``df`` to the shared folder and reading it back.

    Survives the loss of executors, unlike cached blocks.
    """
    path = new_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
