"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: str = "*", app: str = "palaver", **conf) -> SparkSession:
    """A single-JVM session for tests and benchmarks; clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables that every executor can read.

    Taken from spark.checkpoint.dir. Only a local session may fall back on a fresh
    temporary folder.
    """
    sc = spark.sparkContext
    setting = "spark.checkpoint.dir"
    named = spark.conf.get(setting, None) or sc.getConf().get(setting) or sc.getCheckpointDir()
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="palaver-")
    sc.setCheckpointDir(made)
    return made


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new sub-folder name in the shared folder."""
    _SCRATCH.append(f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}")
    return _SCRATCH[-1]


def drop_scratch(spark: SparkSession) -> int:
    """Delete the intermediate folders this driver has made so far; how many there were.

    For a caller that is done with all frames built on them.
    """
    conf, n = spark.sparkContext._jsc.hadoopConfiguration(), len(_SCRATCH)
    while _SCRATCH:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def spread_small_scan(df):
    """Fan a scan out over all cores when it has fewer partitions than there are cores.

    A file with a single row group is read by one task, and all expressions on its rows
    would run there. Inputs of many files (any large table) are returned unchanged, so this
    never adds a shuffle at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def write_once(df):
    """Store the rows as a table in the shared folder and go on from there.

    Cuts the lineage in a way that survives lost executors; later reads are columnar and have
    known sizes.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "rows")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
