"""Tables written to the folder all executors share, so that later plans are short and lost executors cost nothing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode, where there is none, a folder of our own."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="glosspan-work-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir("file://" + own)
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def spread_rows(df: DataFrame, *keys: str) -> DataFrame:
    """The rows in as many tasks as a shuffle has, three a core at least: adaptive execution joins small shuffles by their bytes, and
    these rows cost time."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), *keys)


def pieces(*tables: DataFrame, mb: int = 4) -> int:
    """Tasks of a shuffle in which none has more than about ``mb`` of the tables as they lie on disk, so that what a task sorts does not
    grow with the input."""
    size = sum(int(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for t in tables)
    least = int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, size // (mb * 2**20)) if size < 2**50 else least  # more is Spark's guess for rows it knows nothing of


def by_key(df: DataFrame) -> DataFrame:
    """The side of a join that grows with the corpus, never broadcast: its size on disk says nothing, as findings and directives
    compress a hundredfold, and the driver would hold all of them."""
    return df.hint("merge")


class Workspace:
    """Tables of one run; ``clear`` deletes them and frees what was cached."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.cached = spark, [], []

    def write(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{shared_folder(self.spark)}/{label}-{uuid.uuid4().hex}"
        self.paths.append(path)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for df in self.cached:
            df.unpersist()
        for path in self.paths:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.paths, self.cached = [], []
