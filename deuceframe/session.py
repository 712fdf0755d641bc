"""Session construction and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SHARED_DIR = "spark.checkpoint.dir"


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "deuceframe") -> SparkSession:
    """A local session with the settings the engine is tuned for."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir, or a temporary one where it is unset.

    The fallback is a folder of this machine, which is right only for local sessions.
    """
    path = spark.conf.get(SHARED_DIR, None) or spark.sparkContext.getConf().get(SHARED_DIR, None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{SHARED_DIR} must name a folder all executors share")
    folder = tempfile.mkdtemp(prefix="deuceframe-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = "file://" + folder
    spark.conf.set(SHARED_DIR, path)
    return path


def ship_package(spark: SparkSession) -> None:
    """Makes the package importable in the Python workers, wherever the driver found it; once for each context."""
    context = spark.sparkContext
    if getattr(context, "_deuceframe_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="deuceframe-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "deuceframe_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent).as_posix())
    context.addPyFile(str(archive))
    context._deuceframe_shipped = True


class Scratch:
    """Tables written to the shared folder, so that later steps neither recompute nor depend on one executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame | None = None) -> DataFrame:
        reader = self.spark.read.schema(like.schema) if like is not None else self.spark.read
        return reader.parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        """Delete a table, or everything when no name is given."""
        remove(self.spark, self.path(name) if name else self.root)

    def keep_only(self, *names: str) -> None:
        """Delete all tables but these: what a result is read from stays, what led to it goes."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(self.root)
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for status in files.listStatus(folder):
            if status.getPath().getName() not in names:
                files.delete(status.getPath(), True)


def _file(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, files = _file(spark, path)
    return files.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    target, files = _file(spark, path)
    files.delete(target, True)
