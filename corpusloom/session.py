"""Sessions and tables that cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Written tables by path.
_written: dict[str, SparkSession] = {}


def _delete(path: str) -> None:
    spark = _written.pop(path, None)
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already; other tables may have another one
        pass


@atexit.register
def _clean() -> None:
    """Tables of this driver are of no use once it ends."""
    for path in list(_written):
        _delete(path)


def drop_table(df: DataFrame) -> None:
    """Delete a table of ``persist_table`` that nothing reads any more."""
    path = df.__dict__.get("_path")
    if path in _written:
        _delete(path)


@contextmanager
def table_scope() -> Iterator[None]:
    """Deletes at its end the tables written inside; results that read them have to be written or collected before."""
    before = set(_written)
    try:
        yield
    finally:
        for path in set(_written) - before:
            _delete(path)


def get_session(app: str = "corpusloom", cores: str = "*") -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see.

    Where it is unset (local tests) a temporary folder is made and removed at
    exit.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, _own[app], True)
    return f"file://{_own[app]}"


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing uses; what is written there lasts as long as a table of ``persist_table``."""
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def persist_table(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, lineage cut, safe against lost executors.

    The table lasts until ``drop_table``, the end of its ``table_scope`` or of
    the driver, as results may read it until then.
    """
    spark = df.sparkSession
    path = new_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._path = path
    return table


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Files that a query shuffled are deleted once it ends, as those of ``persist_table`` are of no use then; else they stay until the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of Parquet files in a folder.

    A table of fewer splits than cores, which is a small one, is spread over
    the cores; columns and filters still reach the scan.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() * 2 <= cores else df
