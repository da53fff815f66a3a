"""Session defaults and the shared scratch folder used to cut lineage and stage tables."""
from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}

# Runtime SQL settings only: they can be applied to a session somebody else created.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "jobstrata", master: str | None = None, shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """A session with the settings the operators expect; `shuffle_partitions` is a local-mode knob only."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for k, v in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir.

    Every executor must reach it, so without that setting only a local master gets a temporary folder; on a cluster the
    missing setting is an error. The folder goes when the driver's Python ends; `Stages` drops its tables earlier."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="jobstrata-")
        _FOLDERS[app] = f"{root.rstrip('/')}/jobstrata-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_forget, spark, _FOLDERS[app])
    return _FOLDERS[app]


def _forget(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None:  # a stopped session has no file system any more
        delete_path(spark, folder)


def delete_path(spark: SparkSession, path: str) -> None:
    """Removes a file or folder of any file system Spark knows."""
    p, fs = _file_system(spark, path)
    fs.delete(p, True)


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder."""
    p, fs = _file_system(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def touch(spark: SparkSession, path: str) -> None:
    """An empty file, complete as soon as it exists."""
    p, fs = _file_system(spark, path)
    fs.create(p, True).close()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder (every executor must be able to reach it)."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """The same rows from a table written once to the shared folder.

    Survives the loss of executors; being columnar, it is read with only the columns each consumer needs, and its size
    is known to the planner, so a join broadcasts it only below spark.sql.autoBroadcastJoinThreshold."""
    return _written(df, scratch_path(df.sparkSession, name))


#: shuffle files of a finished execution go at once instead of when the driver's collector finds their plan unused
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written(df: DataFrame, path: str) -> DataFrame:
    """The table is read from now on, so what was shuffled to make it is of no more use."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Stages:
    """Scratch tables of one operator: `keep` writes a table, `drop` removes those no longer read.

    What the operator's result still reads stays until the application ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self._paths = spark, {}

    def keep(self, df: DataFrame, name: str = "stage") -> DataFrame:
        path = scratch_path(self.spark, name)
        out = _written(df, path)
        self._paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path, _ = self._paths.pop(id(t), (None, None))
            if path:
                delete_path(self.spark, path)
