"""Session settings and the shared folder that intermediate tables go to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app_name: str = "tidegauge", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session with the settings the operators rely on.

    Dots in configuration names are written as ``__`` in keyword arguments,
    e.g. ``spark__sql__shuffle__partitions="8"``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # State of streams grows with the entities of open windows; keep it off the heap.
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        # Recording the Python line of every column expression costs more than
        # the expression when a plan has hundreds of them.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.ui.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then gets a temporary
    folder, remembered for the rest of the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="tidegauge-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one table under the shared folder."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/{app}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back, so later uses neither recompute it
    nor depend on the executors that produced it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_dropped: dict[str, int] = {}


def scratch_generation(spark: SparkSession) -> int:
    """How often this application's tables were removed; what was made before is gone."""
    return _dropped.get(spark.sparkContext.applicationId, 0)


def drop_scratch(spark: SparkSession) -> None:
    """Remove the tables this application has put in the shared folder."""
    _dropped[spark.sparkContext.applicationId] = scratch_generation(spark) + 1
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as Spark's readers report it."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(hadoop_path).toString().rstrip("/")


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def any_path(spark: SparkSession, pattern: str) -> bool:
    """Whether a file or folder matches the pattern."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(len(hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop_path) or []))


def path_version(spark: SparkSession, path: str) -> str:
    """Size and modification time of a file or a whole folder, to key cached results.

    A folder is listed by Spark; the content of its files is not read.
    """
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop_path)
    if status.isFile():
        return f"{path}|{status.getModificationTime()}|{status.getLen()}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    found = files.agg(F.max("modificationTime"), F.sum("length"), F.count(F.lit(1))).head()
    return "|".join(map(str, (path, *found)))
