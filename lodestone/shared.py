"""Cutting lineage through a folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's switch to delete a query's shuffle files once the query is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where the session names none: that of the context, or a
    folder of this machine if the master is local; on a cluster an error, for executors couldn't read it."""
    named, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not named:
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local"):
                raise OSError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        named = context.getCheckpointDir()
    # with its scheme, so that readers and writers outside the JVM take the same file system
    path = spark._jvm.org.apache.hadoop.fs.Path(named)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later steps neither recompute it nor
    depend on the executors that made it. Its shuffle files, of no more use, go as soon as it is written."""
    spark = df.sparkSession
    path, before = new_folder(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete the files of tables from :func:`materialize` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
            if "/lodestone/" in parent:
                path = jvm.org.apache.hadoop.fs.Path(parent)
                path.getFileSystem(conf).delete(path, True)
