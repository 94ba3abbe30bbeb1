"""Session settings and shared scratch tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings every job relies on.  Broadcast decisions stay with
# Spark's own size checks; adaptive execution splits skewed join partitions.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

_local_scratch: str | None = None
_written: list[str] = []


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("biblioweave")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables.

    On a cluster this is the shared ``spark.checkpoint.dir``; a local session
    without that setting gets one temporary folder per process.
    """
    global _local_scratch
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/biblioweave"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="spark-biblioweave-")
    return _local_scratch


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path for an intermediate table or landed files, deleted by ``release_scratch``."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the scratch folder and read it back.

    Used where one result feeds several branches of a job.  The written table
    survives the loss of executors and gives the planner real sizes.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_scratch(spark: SparkSession, labels: tuple[str, ...] | None = None) -> None:
    """Delete the scratch tables of this process (only those with one of ``labels``), once no result needs them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    chosen = [p for p in _written if labels is None or p.rsplit("/", 1)[1].rsplit("-", 1)[0] in labels]
    for done in chosen:
        _written.remove(done)
        path = jvm.org.apache.hadoop.fs.Path(done)
        path.getFileSystem(conf).delete(path, True)


def spread(scan: DataFrame, *key: str) -> DataFrame:
    """A file scan with at least one partition per core.

    Small tables come in fewer splits than there are cores and are hashed by
    ``key``; large ones have more splits and stay as they are.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, *key) if scan.rdd.getNumPartitions() < cores else scan
