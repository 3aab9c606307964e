"""Session helpers: a tuned local builder and the folder shared by all executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SHARED_DIR_CONF = "spark.checkpoint.dir"
_handed_out: list[str] = []


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidelog")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder named by ``spark.checkpoint.dir``.

    Only where the session names none (tests, a laptop) is one made, below the local temporary folder;
    it is then set as the session's checkpoint folder too.
    """
    base = spark.conf.get(SHARED_DIR_CONF, None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = known.get() if known.isDefined() else ""
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SHARED_DIR_CONF} to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        spark.sparkContext.setCheckpointDir(base)
    _handed_out.append(path := f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}")
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving what operators have put into the shared folder since: results must have been read or written by then."""
    known = len(_handed_out)
    try:
        yield
    finally:
        discard(spark, known)


def discard(spark: SparkSession, since: int = 0) -> None:
    """Delete the intermediate tables and stream folders that operators have made in this process; their results can no longer be read."""
    while len(_handed_out) > since:
        delete_path(spark, _handed_out.pop())


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder; survives the loss of executors."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def make_dir(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)


def rename_path(spark: SparkSession, path: str, to: str) -> None:
    jvm = spark.sparkContext._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(to)
    if not a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(a, b):
        raise OSError(f"cannot rename {path} to {to}")


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _children(spark: SparkSession, path: str, dirs: bool) -> list[str]:
    if not path_exists(spark, path):
        return []
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    return sorted(s.getPath().getName() for s in found if s.isDirectory() == dirs)


def child_dirs(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below ``path`` (none if it does not exist)."""
    return _children(spark, path, True)


def child_files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files directly below ``path`` (none if it does not exist)."""
    return _children(spark, path, False)


def create_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that must not exist yet."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        out = fs.create(p, False)
    except Exception as e:
        if fs.exists(p):
            raise FileExistsError(path) from e
        raise
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def stream_path(spark: SparkSession, path: str) -> str:
    """``path`` as the streaming file source takes it: a single file must be given as a pattern."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    single = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()
    return f"{path[:-1]}[{path[-1]}]" if single else path
