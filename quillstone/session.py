"""Session settings that every entry point of the library assumes."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

#: Settings that change results, so they hold on any cluster.
SEMANTICS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | None = None, shuffle_partitions: int | None = None, name: str = "quillstone") -> SparkSession:
    """A single-JVM session for tests and the bench."""
    cores = cores or os.cpu_count() or 4
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in SEMANTICS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.driver.memory", os.environ.get("QUILLSTONE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()
_LOCAL_DIRS: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir.

    A folder of our own is made only where the setting is absent and the master is a
    single JVM, as in tests.
    """
    import atexit
    import shutil
    import tempfile

    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _LOCAL_DIRS:
        _LOCAL_DIRS.append(tempfile.mkdtemp(prefix="quillstone-"))
        atexit.register(shutil.rmtree, _LOCAL_DIRS[0], True)
    return _LOCAL_DIRS[0]


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that Python stages import it wherever they run."""
    import tempfile
    import zipfile
    from pathlib import Path

    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="quillstone-")) / "quillstone.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as packed:
        for path in sorted(root.rglob("*.py")):
            packed.write(path, f"{root.name}/{path.relative_to(root)}")
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(application)


def cut(df: DataFrame) -> DataFrame:
    """Eager, reliable checkpoint in the shared folder: what several steps read is worked out once, and lost executors are survived."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def sweep(spark: SparkSession) -> None:
    """Lets go of shuffle files that no table needs any more: Spark deletes them when the driver's JVM collects its garbage, which else may take many steps."""
    spark.sparkContext._jvm.System.gc()
