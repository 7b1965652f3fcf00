"""Tables written into the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[tuple[str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where it is unset.

    Only a local master may go without the setting: a machine's own folder is no use to a cluster."""
    sc = spark.sparkContext
    conf = sc.getConf()
    if found := conf.get("spark.checkpoint.dir"):
        return found.rstrip("/")
    master = conf.get("spark.master", "local")
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not hasattr(sc, "_nearmark_shared_dir"):
        own = tempfile.mkdtemp(prefix="nearmark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc._nearmark_shared_dir = own
    return sc._nearmark_shared_dir


def new_folder(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one, on whatever file system that is; it goes when the session's JVM ends."""
    at = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return at


def remove(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes beyond which the JVM compiles no method, but goes on interpreting it.
JIT_LIMIT = 8000


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """Stages whose code would be one method too large for the JVM's compiler run as operators, in smaller methods."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, JIT_LIMIT)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(spark: SparkSession, name: str, build: Callable[[], DataFrame], large: bool = False) -> DataFrame:
    """The table build() makes, from Parquet; built at its first use in a session.  large: of long expressions.

    Long derivations end here: what reads the table plans over plain columns, and a lost executor costs a read."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _WRITTEN:
        at = f"{new_folder(spark, 'table')}/rows"
        rows = build()
        with small_methods(spark) if large else nullcontext():
            rows.write.parquet(at)
        _WRITTEN[key] = at
    return spark.read.parquet(_WRITTEN[key])
