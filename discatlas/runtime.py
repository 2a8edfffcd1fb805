"""Session defaults and the shared folder in which lineage is cut."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
HUGE_METHOD = "spark.sql.codegen.hugeMethodLimit"


def session(app: str = "discatlas", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects; the cluster's own settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where the setting is absent and the session is local does a folder of
    this machine serve; on a cluster without the setting this raises.
    """
    found = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
    path = os.path.join(tempfile.gettempdir(), f"discatlas-{os.getuid()}", "shared")
    os.makedirs(path, exist_ok=True)
    return f"file://{path}"


def _until_exit(spark: SparkSession, path: str) -> None:
    """Have a path of the shared folder removed when the application ends; it is kept as long as plans may read it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _until_exit(spark, path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint df in the shared folder and go on from the files: survives lost executors, keeps the order within partitions."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
        _until_exit(spark, context.getCheckpointDir())
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as a compressed table to the shared folder and go on from it, as `cut` does but in less room and without an order."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prepare(spark: SparkSession) -> None:
    """Make a session fit for the engine: generated code of compilable size, and this package on the workers."""
    # The JVM doesn't compile methods over 8,000 bytes of bytecode; wide projections then run interpreted.
    if spark.conf.get(HUGE_METHOD, "65535") == "65535":
        spark.conf.set(HUGE_METHOD, "8000")
    _ship(spark)


def _ship(spark: SparkSession) -> None:
    """Send this package to the workers, once per application, so that their Python finds it wherever it was started."""
    context = spark.sparkContext
    if getattr(context, "_discatlas_shipped", False):
        return
    root = Path(__file__).resolve().parent
    # Executors fetch it from the driver whenever they start, so it lives as long as the application.
    archive = Path(SparkFiles.getRootDirectory(), "packages", "discatlas.zip")
    archive.parent.mkdir(exist_ok=True)
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._discatlas_shipped = True
