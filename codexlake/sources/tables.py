"""Parquet table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One table of a folder of Parquet tables."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def attach(spark: SparkSession, base: str, names: list[str], alias: str) -> list[str]:
    """Tables of a second folder as views <alias>_<name>, so that one statement may read both; the views' names."""
    for name in names:
        table(spark, base, name).createOrReplaceTempView(f"{alias}_{name}")
    return [f"{alias}_{name}" for name in names]


def kept_dir(spark: SparkSession) -> str:
    """A folder below the one that all machines share (spark.checkpoint.dir); one of our own only where all runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        path = getattr(spark.sparkContext, "_codexlake_kept", None)
        if path is None:
            import tempfile

            path = spark.sparkContext._codexlake_kept = "file://" + tempfile.mkdtemp(prefix="codexlake-")
    return f"{path}/codexlake"


def fingerprint(df: DataFrame) -> str:
    """A name for the state of the files that a table is read from: their paths, sizes and times."""
    import hashlib

    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    state = []
    for f in sorted(df.inputFiles()):
        where = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f))
        status = where.getFileSystem(conf).getFileStatus(where)
        state.append(f"{f} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(state).encode()).hexdigest()[:24]


def settled(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder; a folder of our own only where all runs in one process."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if path is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
            import tempfile

            path = tempfile.mkdtemp(prefix="codexlake-")
        sc.setCheckpointDir(path)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: rows of a table that is read in fewer parts, or lies in few of them, are dealt out anew.

    A file is cut by its bytes, but the rows of a row group all go to one of the parts: a file with one row group gives
    many parts of which one has the rows. Counting them reads no column.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        rows = [r[0] for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).select("n").collect()]
        if max(rows, default=0) * cores <= 2 * sum(rows):
            return df
    return df.repartition(4 * cores)
