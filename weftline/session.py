"""Session defaults and the one way the library cuts lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: By application: the folder that stands in for a shared one, and the tables written.
_LOCAL: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def local_session(cores: int = 8, memory: str = "12g", app: str = "weftline") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset, a session on one machine gets a temporary folder; on a cluster, where executors
    would each write to a disk of their own, it is an error.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    known = _LOCAL.get(spark.sparkContext.applicationId)
    if known is None:
        known = _LOCAL[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, known, ignore_errors=True)
    return "file://" + known


def keep_until_end(spark: SparkSession, path: str) -> None:
    """Remember a path to be deleted at the end."""
    app = spark.sparkContext.applicationId
    if app not in _WRITTEN:
        _WRITTEN[app] = []
        atexit.register(drop_written, spark)
    _WRITTEN[app].append(path)


def drop_written(spark: SparkSession) -> int:
    """Delete the tables that this session has written to the shared folder; how many there were.

    It runs when the driver ends, if the session is still alive then. DataFrames that read them are of no more use after it.
    """
    try:
        paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in paths:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        return len(paths)
    except Exception:  # the session is gone
        return 0


def written(df: DataFrame, name: str, partition_by: list[str] | None = None, per_file: int = 0) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back; at most ``per_file`` rows a file if that is given.

    The table survives the loss of executors, is smaller than an RDD checkpoint and keeps column
    pruning and predicate pushdown for its readers. The files go when the session ends (``drop_written``).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    keep_until_end(spark, path)
    writer = df.write.option("compression", "zstd").option("maxRecordsPerFile", per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
