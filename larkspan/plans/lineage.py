"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, else the one set as checkpoint directory. Only a local session, whose tasks all run on this machine, may go without: it gets a temporary
    one. On a cluster that is an error, as executors of other hosts would not see it."""
    sc = spark.sparkContext
    if named := spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if (own := sc._jsc.sc().getCheckpointDir()).isDefined():
        return own.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="larkspan-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    sc.setCheckpointDir(f"file://{made}")
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so that a lost executor costs no recomputation of what came before."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/larkspan-{label}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(clean)
    _made.append((spark, path))
    return path


def store(df: DataFrame, label: str) -> DataFrame:
    """df written as a compressed table in the shared folder and read again. Smaller than a checkpoint of serialised rows."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of that path, in any file system."""
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def drop(df: DataFrame) -> None:
    """Removes a table that store() wrote, once nothing will read it again: for the rounds of an iteration, of which only the last is kept."""
    for f in df.inputFiles()[:1]:
        mine = [(s, p) for s, p in _made if f"/{p.rsplit('/', 1)[-1]}/" in f]
        for spark, path in mine:
            fs, p = _file_system(spark, path)
            fs.delete(p, True)
            _made.remove((spark, path))


def clean() -> None:
    """Removes every table written by store() in this process."""
    for spark, path in _made:
        try:
            fs, p = _file_system(spark, path)
            fs.delete(p, True)
        except Exception:  # noqa: BLE001 - the session may have ended before
            pass
    _made.clear()
