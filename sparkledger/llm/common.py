"""What the operators of this subpackage share: scratch tables, shipping, hashing."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import shutil
import tempfile
import threading
import uuid
import zipfile
from contextlib import contextmanager
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
_OWN: list[tuple[str, str]] = []


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that tasks can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="spark-ship-"), f"{root.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where that is unset and the master is local (tests)."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = next((d for a, d in _OWN if a == sc.applicationId), None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-scratch-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = "file://" + folder
        _OWN.append((sc.applicationId, base))
    return base.rstrip("/")


class _Open(threading.local):
    def __init__(self):
        self.owners: list[list[str]] = []


_OPEN = _Open()


@contextmanager
def owned(spark: SparkSession):
    """Scratch paths made within belong to the list that this gives; their owner deletes them with drop(). An error deletes them at once."""
    own: list[str] = []
    _OPEN.owners.append(own)
    try:
        yield own
    except BaseException:
        drop(spark, own)
        raise
    finally:
        _OPEN.owners.remove(own)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _OPEN.owners:
        _OPEN.owners[-1].append(path)
    return path


def drop(spark: SparkSession, own: list[str], but: tuple[str, ...] = ()) -> None:
    """Delete the paths of one owner, except some. Only for owners that know no frame reads them any more."""
    for path in [p for p in own if p not in but]:
        delete(spark, path)
        own.remove(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete one scratch path through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def tidy(name: str):
    """For operators of a frame whose result is small: the result is written as a table, and what else was written on the way goes."""

    def of(f):
        @wraps(f)
        def run(df: DataFrame, *args, **named) -> DataFrame:
            spark = df.sparkSession
            with owned(spark) as own:
                out = f(df, *args, **named)
                path = new_path(spark, name)
                own.remove(path)
                result = table(spark, out, name, path)
            drop(spark, own)
            if _OPEN.owners:
                _OPEN.owners[-1].append(path)
            return result

        return run

    return of


def table(spark: SparkSession, df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back."""
    path = path or new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(spark: SparkSession, df: DataFrame, name: str, by: str) -> DataFrame:
    """Written in buckets by a column and read back: joins by this column read the rows where they lie, and deal out only the other side.

    Buckets need a name in the catalogue; it goes at once, as the frame knows its files."""
    path, table = new_path(spark, name), f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).saveAsTable(table)
    try:
        return spark.table(table)
    finally:
        spark.sql(f"DROP TABLE {table}")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def filesystem(uri: str):
    """pyarrow's file system and path for a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def put_file(uri: str, data_writer) -> None:
    """Write a file whole or not at all: a task that is run again replaces its own file."""
    f, path = filesystem(uri)
    f.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with f.open_output_stream(part, buffer_size=1 << 20) as out:
        data_writer(out)
    f.move(part, path)


#: What a Python worker keeps from task to task, by kind.
CACHES: dict[str, dict] = {}


def give_back() -> None:
    """Return freed memory to the system: a worker outlives its task, and shares its executor with the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def task(cache: str | None = None):
    """For functions of batches: caches of other kinds go before the first batch, freed memory after the last."""

    def of(f):
        @wraps(f)
        def run(*args, **named):
            for kind in [k for k in CACHES if k != cache]:
                del CACHES[kind]
            try:
                yield from f(*args, **named)
            finally:
                give_back()

        return run

    return of


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def slices(texts: list, most: int):
    """Cut a batch into runs of rows holding about `most` characters, a longer row alone."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def crc32_of_ids(ids: bytes) -> int:
    import zlib

    return zlib.crc32(ids)


def fold(doc_id) -> "F.Column":
    """crc32 of the id as text, modulo 3: fold 1 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(3)
