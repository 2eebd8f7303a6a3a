"""Session helpers: a local session for tests and the checkpoint folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Spark's setting that removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "8", app: str = "lumenmatch") -> SparkSession:
    """Session for tests and the bench. A cluster brings its own session and settings."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def many_tasks(spark: SparkSession) -> int:
    """Tasks for rows that are small to move but long to work on: Spark would deal such rows by their bytes to a few."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without that setting gets a temporary
    folder; elsewhere a missing setting is an error, since executors could not read a driver-local folder.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can read")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/staged-{spark.sparkContext.applicationId}"


def staged(df, name: str, tidy: bool = False):
    """Write an intermediate table once to the shared folder and read it back.

    Used where several branches need the same expensive rows: they are computed once, and a lost executor costs only
    the tasks it was running. The tables belong to the application: ``release_staged`` deletes them, at the latest when the
    driver's Python ends. With ``tidy``, the shuffle files of the write go as soon as it is done.
    """
    spark = df.sparkSession
    folder = _folder(spark)
    if folder not in _OWNED:
        _OWNED.add(folder)
        atexit.register(release_staged, spark)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    if tidy:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if tidy:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def discard(*tables) -> None:
    """Deletes staged tables that no later step reads; what was derived from them must have been written before."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._staged_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_OWNED: set[str] = set()


def release_staged(spark: SparkSession) -> None:
    """Deletes the application's staged tables; results that still read them must have been written before."""
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
