"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = 8, **extra: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("postsift")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or a temporary one on local masters."""
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_CONF} must name a shared folder on a cluster")
    fallback = tempfile.mkdtemp(prefix="postsift-")
    spark.conf.set(CHECKPOINT_CONF, fallback)
    return fallback


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/postsift/{name}-{uuid.uuid4().hex}"


def write_stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder; returns the table read back and its path.

    A written table outlives lost executors, keeps column pruning, and gives the optimizer real
    file sizes, which an RDD checkpoint does not.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    return write_stage(df, name)[0]


def remove_stage(spark: SparkSession, path: str) -> None:
    """Delete a stage that a later written stage has replaced."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
