"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import barloom

CHECKPOINT_CONF = "spark.checkpoint.dir"

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # A tile with its halo (see operators.tiles) stays in the window's row buffer.
    "spark.sql.windowExec.buffer.in.memory.threshold": "32768",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime options the operators rely on; cluster sizing is left alone.

    The few Python functions travel by value, so workers need no copy of the package.
    """
    cloudpickle.register_pickle_by_value(barloom)
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    # Iterative models cut their lineage there; set where the cluster has not done so itself.
    if spark.sparkContext.getCheckpointDir() is None and spark.conf.get(CHECKPOINT_CONF, None):
        spark.sparkContext.setCheckpointDir(spark.conf.get(CHECKPOINT_CONF))
    return spark


def local_session(cores: int | str = 8, app: str = "barloom", **conf: str) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local mode with none set."""
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):  # `local-cluster` is a cluster
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="barloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's folder within the shared one."""
    return f"{shared_dir(spark)}/barloom/{spark.sparkContext.applicationId}"


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{own_dir(spark)}/{label}-{uuid.uuid4().hex}"


def remove_stored(spark: SparkSession) -> bool:
    """Delete all that this application has stored, once none of it is read any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def store(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage; later reads still prune columns, and the planner knows the size:
    it broadcasts the table below its threshold and shuffles it otherwise. So a small
    derived table is stored before it meets a large one on a skewed key.
    """
    path = fresh_dir(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
