"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir. Only a local master, as in tests, may do without the setting
    and use a folder of the machine; on a cluster other machines would not find the tables."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.gettempdir()
    return f"{named.rstrip('/')}/storyloom-{spark.sparkContext.applicationId}"


BATCH = 1000  # rows that a Python worker is sent at a time, at most


@contextlib.contextmanager
def short_batches(spark: SparkSession):
    """Meanwhile batches have BATCH rows at most. An executor holds a batch outside its heap several times over, so that
    Spark's 10,000 rows of whole texts take hundreds of MB."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), BATCH) if int(before) > 0 else BATCH))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, label: str, *folders: str) -> DataFrame:
    """df as a table that is written once, however often it is read, in a folder for each value of the columns `folders`;
    lineage ends here and survives lost executors. The table stays until discard() or sweep()."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    with short_batches(df.sparkSession):
        df.write.partitionBy(*folders).parquet(path) if folders else df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._storyloom_path = path
    return out


class Parts:
    """A table that is written part by part and read by part or as a whole, by a plan that doesn't grow with their number.
    It stays until sweep()."""

    def __init__(self, spark: SparkSession, schema: str, label: str):
        self.reader = spark.read.schema(schema).option("recursiveFileLookup", "true")
        self.path, self.parts = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", 0

    def add(self, df: DataFrame) -> DataFrame:
        path = f"{self.path}/{self.parts}"
        self.parts += 1
        with short_batches(df.sparkSession):
            df.write.parquet(path)
        return self.reader.parquet(path)

    def whole(self) -> DataFrame:
        return self.reader.parquet(self.path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._storyloom_path)


def spread(df: DataFrame) -> DataFrame:
    """A table dealt out to all cores where its files make fewer tasks than there are cores, as one small file does; any
    other stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def sweep(spark: SparkSession) -> None:
    """Delete the tables of this application; results that read them are lost."""
    _delete(spark, shared_dir(spark))
