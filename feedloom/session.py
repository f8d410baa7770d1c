"""Session settings and the shared folder used for written intermediates."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

LOCAL_MASTER = r"local($|\[)"

_SHIPPED: set[str] = set()
_OWN_DIRS: dict[str, str] = {}


def build_session(app: str = "feedloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    On a cluster leave ``master`` unset and let spark-submit decide; shuffle
    partition counts are left to the cluster's configuration and AQE.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def qualified(spark: SparkSession, path: str) -> str:
    """The path with scheme and host, as Spark's own readers and writers take it."""
    context = spark.sparkContext
    named = context._jvm.org.apache.hadoop.fs.Path(path)
    return named.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(named).toString()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own. On a cluster a bare
    name is a folder of Spark's default filesystem, and comes with its scheme from here on.
    """
    local = re.match(LOCAL_MASTER, spark.sparkContext.master)
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return (named if local else qualified(spark, named)).rstrip("/")
    if not local:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _OWN_DIRS:
        _OWN_DIRS[application] = tempfile.mkdtemp(prefix="feedloom-")
    return _OWN_DIRS[application]


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no earlier write has used."""
    return f"{shared_dir(spark)}/feedloom/{label}-{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table written under the shared folder.

    Cuts lineage where a costly input (a scan of whole texts for their sizes) is
    used more than once, and survives the loss of executors.
    """
    where = fresh_dir(df.sparkSession, label)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """A small table over many tasks, for rows that grow into many.

    The fixed count keeps the adaptive planner, which sees only the small input,
    from putting all the work into one task.
    """
    session = df.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    return df.repartition(tasks, *columns)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="feedloom-ship-"), "feedloom_package.zip")
    with zipfile.ZipFile(archive, "w") as bundle:
        for folder, _, files in os.walk(root):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    bundle.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)
