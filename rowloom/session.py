"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "rowloom", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.files.openCostInBytes", "1m")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Where that is unset, a folder in the session's warehouse, which executors share too, unless it lies on
    the driver's own disk while the executors are other machines; that is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/rowloom-scratch"
    if not shared(spark.sparkContext.master, _files(spark, folder).getUri().getScheme()):
        raise ValueError(f"{folder} is on the driver's disk; set spark.checkpoint.dir to a folder that all executors share")
    return folder


def shared(master: str, scheme: str | None) -> bool:
    """Whether the executors of ``master`` see the files of a file system."""
    return scheme != "file" or master.startswith("local")


def _files(spark: SparkSession, path: str):
    """The file system that holds a path."""
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


#: Where the tables of ``materialize`` lie.
_WRITTEN: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


#: The paths of the innermost ``scratch`` block.
_OWNED: ContextVar[list[str] | None] = ContextVar("owned", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end of the block what was written to the shared folder inside it.

    For sessions that run many plans: collect or write the results inside the block. Blocks may be
    nested; each owns what is made directly in it. Without a block the data stay until the application ends.
    """
    paths: list[str] = []
    token = _OWNED.set(paths)
    try:
        yield
    finally:
        _OWNED.reset(token)
        for path in paths:
            _delete(spark, path)


@contextmanager
def outlasting() -> Iterator[None]:
    """What is written inside stays until the application ends, whatever ``scratch`` block is around."""
    token = _OWNED.set(None)
    try:
        yield
    finally:
        _OWNED.reset(token)


def _delete(spark: SparkSession, path: str) -> None:
    _files(spark, path).delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path nobody has used yet, below the application's own part of the shared folder.

    It is deleted at the end of the ``scratch`` block that asked for it, at the latest with the application.
    """
    root = f"{shared_folder(spark)}/rowloom-{spark.sparkContext.applicationId}"
    target, files = spark._jvm.org.apache.hadoop.fs.Path(root), _files(spark, root)
    if not files.exists(target):
        files.mkdirs(target)
        files.deleteOnExit(target)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    paths = _OWNED.get()
    if paths is not None:
        paths.append(path)
    return path


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Cuts lineage, fixes values that a recomputation could change (such as
    generated ordinals) and survives the loss of executors.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[made] = path
    return made


def discard(df: DataFrame) -> None:
    """Delete the written table behind a ``materialize`` result that is no longer needed."""
    path = _WRITTEN.get(df)
    if path:
        _delete(df.sparkSession, path)
