"""Session defaults and the few places where cluster settings are read."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def get_spark(cpus: int | str = "*", app: str = "cladeframe", memory: str = "12g") -> SparkSession:
    """Local session for tests and the bench; clusters pass their own session."""
    n = 8 if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.pythonUDF.arrow.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for written intermediates.

    The cluster names it in ``spark.checkpoint.dir``; only a local session without that
    setting (tests, laptops) gets a temporary one, as other machines couldn't see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if named:
        if current.isEmpty():
            sc.setCheckpointDir(named)
        return named
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="cladeframe-")
    sc.setCheckpointDir(made)
    return made


def ship(spark: SparkSession) -> None:
    """Let tasks import this package wherever the driver was started.

    Executors on the driver's machine find its folder on their path; others get the package as a file.
    """
    sc, root = spark.sparkContext, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root in paths:
        return
    sc.environment["PYTHONPATH"] = os.pathsep.join(p for p in [root, *paths] if p)
    if not sc.master.startswith("local"):
        archive = os.path.join(tempfile.mkdtemp(prefix="cladeframe-"), "cladeframe.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for folder, _, names in os.walk(os.path.join(root, "cladeframe")):
                for n in names:
                    if n.endswith(".py"):
                        path = os.path.join(folder, n)
                        z.write(path, os.path.relpath(path, root))
        sc.addPyFile(archive)


def parallelism(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)
