"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that removes a query's shuffle files once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: `spark.checkpoint.dir`, or one of our own on a single machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, survives lost executors.

    What the writing query shuffled is removed once the table is written; the table stays until `discard`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt evenly over all cores: what is worked out for each row of a small file would else be one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def discard(*tables: DataFrame) -> None:
    """Remove materialized tables that no DataFrame reads any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            inside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark)).toUri().getPath()
            if not path.toUri().getPath().startswith(f"{inside}/"):
                raise ValueError(f"{folder} is no table of the shared folder")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
