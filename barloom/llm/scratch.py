"""Staged tables: intermediate results written once to the folder all executors share.

A staged table cuts lineage: if an executor is lost, its readers reread files instead of
recomputing (or losing) what a cached block held. Parquet is used rather than
`DataFrame.checkpoint()` because a reliable checkpoint runs its plan twice.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset (tests), a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="barloom-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and return a frame that reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a staged table that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of the Arrow batches that go to Python, and the setting that holds them.
BATCH_BYTES, _SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to BATCH_BYTES unless the session has a smaller limit: rows are texts of any length, so that a number of rows bounds nothing."""
    now = spark.sql(f"SET {_SETTING}").first()[1]
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(_SETTING, str(BATCH_BYTES))
