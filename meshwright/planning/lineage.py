"""Cutting lineage through tables in the folder that all executors share.

Iterative operators write each round as Parquet into ``spark.checkpoint.dir`` and read it
back. A lost executor therefore costs a re-read, never a recomputation of earlier rounds.
Only a local session without the setting (tests, notebooks) gets a folder of its own; on a
cluster the executors would write to different disks, so there it is an error.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_own_folders: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _own_folders.append(tempfile.mkdtemp(prefix="meshwright-"))
        folder = "file://" + _own_folders[-1]
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a frame that reads it."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; what is written there goes when the process ends, or with ``release``."""
    path = f"{shared_folder(spark)}/meshwright-{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def mark() -> int:
    """A point in time for ``release``."""
    return len(_written)


def release(since: int = 0) -> None:
    """Delete the tables written since ``mark()``; frames that read them fail afterwards."""
    for spark, path in _written[since:]:
        _delete(spark, path)
    del _written[since:]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete the table behind a frame that ``materialise`` returned; later reads of it fail."""
    paths = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for entry in list(_written):
        spark, path = entry
        if any(p.rstrip("/").endswith(path.rsplit("/", 1)[-1]) for p in paths):
            _delete(spark, path)
            _written.remove(entry)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone already
            pass
    for folder in _own_folders:
        shutil.rmtree(folder, ignore_errors=True)
