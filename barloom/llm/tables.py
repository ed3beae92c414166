"""Cutting lineage, and reading the corpus tables."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a local session without one gets its own, as in tests; on a cluster that is an error."""
    sc = spark.sparkContext
    there = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not there:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        there = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(there)
    return there.rstrip("/")


#: Spark's own setting to delete the shuffle files of an execution when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df as a table in the shared folder, read again: what follows does not depend on executors' own disks.

    The shuffle files of the execution go when the table is complete.
    """
    spark = df.sparkSession
    path = path or new_path(spark)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"


class Scratch:
    """Written tables that are deleted when the block ends; what is read after it has to be `written` by itself."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, []

    def __enter__(self):
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        path = new_path(self.spark)
        self.tables.append((written(df, path), path))
        return self.tables[-1][0]

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for _, path in (t for t in self.tables if any(t[0] is f for f in frames)):
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        self.tables = [t for t in self.tables if not any(t[0] is f for f in frames)]

    def __exit__(self, *_):
        self.drop(*(t[0] for t in self.tables))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
