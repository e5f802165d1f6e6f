"""SparkSession construction and lineage-cut helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings the whole library assumes: AQE re-plans joins and coalesces small
# shuffles, ANSI arithmetic is on (Spark 4 default), timestamps are UTC.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "basketry", conf: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's settings.

    The library names no master and no memory of its own: on a cluster both
    come from spark-submit, and a value set in code would override it. Tests
    and the bench pass ``master`` and ``conf``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in {**DEFAULT_CONF, **(conf or {})}.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if on_one_machine(spark):
        ensure_checkpoint_dir(spark)
    return spark


def on_one_machine(spark: SparkSession) -> bool:
    """True for a plain local master, whose executors share the driver's disk."""
    return re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) is not None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder.

    A cluster names it in ``spark.checkpoint.dir``; it is never overridden. A
    plain local session without one gets a scratch folder; anywhere else a
    machine's own folder would be out of the executors' reach, so it is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not on_one_machine(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="basketry-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return conf_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/basketry-{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, codec: str | None = None, file_rows: int | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: build once, read many times.

    ``codec`` is the Parquet compression, the session's own if not given.
    ``file_rows`` bounds the rows of a file, and so of a task that reads narrow
    rows: a task takes few files, as each counts as openCostInBytes at least.
    """
    path = scratch(df.sparkSession, name)
    out = df.write.option("compression", codec) if codec else df.write
    (out.option("maxRecordsPerFile", file_rows) if file_rows else out).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_path = path
    if (made := _MADE.get()) is not None:
        made.append(out)
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of :func:`scratch`."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`saved` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_saved_path", None)
        if path:
            remove(df.sparkSession, path)


_MADE: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


@contextmanager
def released() -> Iterator[None]:
    """Tables of :func:`saved` that are made here are deleted at the end: what is kept is written elsewhere."""
    token = _MADE.set([])
    try:
        yield
    finally:
        discard(*_MADE.get())
        _MADE.reset(token)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
