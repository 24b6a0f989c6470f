"""Session helpers: settings, table reading and the shared folder for cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "wattloom", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor reaches, from ``spark.checkpoint.dir``.

    Only where it is unset on one machine (tests) a folder of this machine is used.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "wattloom-shared")


class Files:
    """Small files and folders of whichever file system a path belongs to, through Spark's own access to it."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def make(self) -> None:
        self._fs.mkdirs(self._path(""))

    def names(self) -> list[str]:
        """What lies directly under the root, sorted."""
        if not self._fs.exists(self._path("")):
            return []
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path("")))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str, overwrite: bool = False) -> None:
        """Fails if the file is there, unless it may be overwritten: of two writers one wins."""
        stream = self._fs.create(self._path(name), overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def remove_at_end(self) -> None:
        self._fs.deleteOnExit(self._path(""))


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared one; it is removed when the application ends, on any file system."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    files = Files(spark, path)
    files.make()
    files.remove_at_end()
    return path


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: survives a lost executor."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """For CPU-bound work on rows: a table that lies in far fewer pieces than there are cores (one
    small file) is dealt out by the keys; anything larger stays as it was scanned."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if 2 * df.rdd.getNumPartitions() <= cores else df
