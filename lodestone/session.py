"""Session defaults and the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; ``conf`` keys use _ for dots."""
    b = SparkSession.builder.appName("lodestone").config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    b = b.config("spark.sql.execution.arrow.pyspark.enabled", "true").config("spark.ui.showConsoleProgress", "false")
    for k, v in conf.items():
        b = b.config(k.replace("_", "."), v)
    return (b.master(master) if master else b).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A local folder serves only where executors are threads of the driver; on a cluster without
    the setting this raises, as tables on local disks would lose rows."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"{tempfile.gettempdir()}/lodestone-shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def importable(spark: SparkSession) -> None:
    """Lets Python workers that share this file system import the package, wherever the driver was started."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH")]))


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of what is in a folder, or none where there is no such folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def touch(spark: SparkSession, path: str) -> None:
    """Makes an empty file: a marker that what stands beside it is whole."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p).close()
