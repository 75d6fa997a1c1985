"""Folders for what a job writes on its way, in the folder that the cluster shares; each has an owner who deletes it."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


class _Owners(threading.local):
    def __init__(self):
        self.open: list[list[str]] = []


_OWNERS = _Owners()


def shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where none is set, a folder of this machine will do for local masters only; it goes with the process."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if sc.applicationId not in _LOCAL:
            folder = tempfile.mkdtemp(prefix="spark-log-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _LOCAL[sc.applicationId] = "file://" + folder
        base = _LOCAL[sc.applicationId]
    return base.rstrip("/")


def new(spark: SparkSession, name: str) -> str:
    """A path that nothing stands at yet. Within owned() it belongs to that owner; else to the caller, who may delete() it when no frame reads it any more."""
    path = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
    if _OWNERS.open:
        _OWNERS.open[-1].append(path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    a, b = fs.Path(path), fs.Path(to)
    if not a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(a, b):
        raise OSError(f"{path} can't become {to}")


@contextmanager
def owned(spark: SparkSession):
    """What is made within goes at the end, also after an error. Frames that read it are of no use after that."""
    own: list[str] = []
    _OWNERS.open.append(own)
    try:
        yield own
    finally:
        _OWNERS.open.remove(own)
        for path in own:
            delete(spark, path)


def table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Written and read back: whatever is made of the result, df is computed once."""
    path = new(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
