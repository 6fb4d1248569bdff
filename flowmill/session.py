"""Session helpers and the shared scratch area."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}
_KEPT_UNTIL_EXIT: set[str] = set()
_SCOPES: list[Scope] = []
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scope:
    """The staged tables of one piece of work; see :func:`scratch_scope`."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def free(self, *tables: DataFrame) -> None:
        """Delete staged tables whose last reader has written its result."""
        for table in tables:
            path = getattr(table, "_staged_at", None)
            if path in self.paths:
                self.paths.remove(path)
                _delete(self.spark, path)

    def keep(self, table: DataFrame) -> DataFrame:
        """A table that the scope's owner hands on; it belongs to the enclosing scope from now on."""
        path = getattr(table, "_staged_at", None)
        if path in self.paths:
            self.paths.remove(path)
            outer = _SCOPES[_SCOPES.index(self) - 1] if self in _SCOPES[1:] else None
            if outer is not None:
                outer.paths.append(path)
        return table


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[Scope]:
    """Owns the tables that :func:`stage` writes inside it and deletes them at its end.

    Work that ends in a staged table needs its own intermediate ones no longer: no later task reads
    them, a repeated one after a lost executor included. ``free`` deletes one earlier and ``keep``
    hands one on. A result that is not staged would still read what the scope deletes.
    """
    scope = Scope(spark)
    _SCOPES.append(scope)
    try:
        yield scope
    finally:
        _SCOPES.remove(scope)
        for path in scope.paths:
            _delete(spark, path)


def local_session(app_name: str = "flowmill", cores: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster bring your own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for staged tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session, whose
    one machine holds every executor, may fall back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="flowmill-")
    return _LOCAL_SCRATCH[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below this application's part of the scratch area.

    The area is removed when the application's JVM ends; :func:`drop_staged` does it earlier.
    """
    root = _app_root(spark)
    if root not in _KEPT_UNTIL_EXIT:
        fs, path = _file_system(spark, root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _KEPT_UNTIL_EXIT.add(root)
    return f"{root}/{label}-{uuid.uuid4().hex}"


def local_folder(spark: SparkSession, path: str) -> str | None:
    """A path of the scratch area as Python's own functions take it, null in a store that only Spark reads."""
    fs, at = _file_system(spark, path)
    whole = fs.makeQualified(at).toUri()
    return whole.getPath() if whole.getScheme() == "file" else None


def _app_root(spark: SparkSession) -> str:
    # other applications may share the scratch folder
    return f"{scratch_root(spark)}/flowmill/{spark.sparkContext.applicationId}"


def _file_system(spark: SparkSession, root: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _delete(spark: SparkSession, path: str) -> None:
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def stage(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with a columnar table: a lost executor re-reads files
    instead of recomputing, and later readers prune columns and row groups.

    It also gives the planner the real size of a lookup. The size of an aggregate is
    unknown up front and taken to be that of its input, so a tiny side table would make
    Spark shuffle the large side; a staged one is compared by file size with
    ``spark.sql.autoBroadcastJoinThreshold``. Nothing in this library is broadcast by hint.

    The table belongs to the innermost :func:`scratch_scope`, or else to the application.
    ``compression`` names a codec other than the session's.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    # what was shuffled for a table is of no use once the table is written
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.set(_FREE_SHUFFLES, before) if before else spark.conf.unset(_FREE_SHUFFLES)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    if _SCOPES:
        _SCOPES[-1].paths.append(path)
    return out


def drop_staged(spark: SparkSession) -> None:
    """Delete everything this application staged so far."""
    root = _app_root(spark)
    fs, path = _file_system(spark, root)
    fs.delete(path, True)
    _KEPT_UNTIL_EXIT.discard(root)
