"""Session-level helpers: the shared folder, written tables that cut lineage, task counts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections import OrderedDict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
#: The setting in which a cluster names the folder that all of its executors share.
SHARED_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediate tables and checkpoints.

    The session's ``spark.checkpoint.dir`` wins.  Only where it is unset (local tests) is a
    temporary folder made, and then recorded in the session so that it is made once.  A cluster without the
    setting is an error: a folder of one machine is none that its executors share.
    """
    found = spark.conf.get(SHARED_DIR, None) or spark.sparkContext.getConf().get(SHARED_DIR, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SHARED_DIR} must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
        spark.conf.set(SHARED_DIR, found)
    return found.rstrip("/")


_scratch: dict[str, tuple] = {}
_lasting: set[str] = set()


def new_path(spark: SparkSession, label: str, keep: bool = False) -> str:
    """A path in the shared folder that nobody else uses, deleted when this program ends unless it is to be kept."""
    path = f"{shared_dir(spark)}/lodestrata/{label}-{uuid.uuid4().hex[:12]}"
    if not keep:
        if not _scratch:
            atexit.register(delete_scratch)
        _scratch[path] = (spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration())
    return path


def delete_scratch() -> None:
    """Deletes the written intermediate tables of this program; results that still read them can be read no more."""
    while _scratch:
        path, (jvm, conf) = _scratch.popitem()
        try:
            _delete(jvm, conf, path)
        except Exception:  # the JVM has gone
            pass


def _delete(jvm, conf, path: str) -> None:
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


def written(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Cuts the lineage in a way that survives the loss of executors: the copy is on shared storage,
    not in executor memory or on executor disks.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the intermediate tables written inside, which nothing may read afterwards; tables of :func:`stored` stay."""
    before = set(_scratch)
    try:
        yield
    finally:
        for path in set(_scratch) - before - _lasting:
            delete_path(spark, path)


def settled(spark: SparkSession, label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` gives, written; the intermediate tables that it took are deleted at once.

    For small results of large work, such as verdicts and reports.
    """
    path = new_path(spark, label)
    with scratch(spark):
        df = build()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Removes a path of :func:`new_path` once nothing reads it any more."""
    _delete(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)
    _scratch.pop(path, None)


_stored: OrderedDict[tuple, object] = OrderedDict()
#: Derived tables that are kept for each application.
STORED = 48


def signature(spark: SparkSession, paths: list[str]) -> tuple:
    """What tells whether the files below some paths are still the same: their names, lengths and times."""
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        out += [(str(f.getPath()), f.getLen(), f.getModificationTime()) for f in path.getFileSystem(conf).listStatus(path)]
    return tuple(sorted(out))


def stored(spark: SparkSession, label: str, inputs: list[str], build: Callable[[str], T]) -> T:
    """What ``build(path)`` made of the files ``inputs`` in the shared folder, made again only if the files have changed.

    The least recently used of more than ``STORED`` such tables is forgotten; its files go when the program ends, as a plan may still read them.
    """
    key = (spark.sparkContext.applicationId, label, signature(spark, inputs))
    if key in _stored:
        _stored.move_to_end(key)
    else:
        path = new_path(spark, label)
        _lasting.add(path)
        _stored[key] = build(path)
        if len(_stored) > STORED:
            _stored.popitem(last=False)
    return _stored[key]


def stored_table(spark: SparkSession, label: str, inputs: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table, written once as long as its inputs stay the same."""

    def write(path: str) -> tuple:
        df = build()
        df.write.parquet(path)
        return path, df.schema

    path, schema = stored(spark, label, inputs, write)
    return spark.read.schema(schema).parquet(path)


def shuffle_tasks(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each application.

    Workers import the functions that they run by name, so the package must be on their path wherever they are.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="lodestrata-ship-"), "lodestrata.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("lodestrata", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as the session has task slots, if its scan has fewer.

    For narrow passes that compute much for each row: a table in one small file would else be worked
    on by one task.  Large tables have more splits than slots and are left as they are, and so are plans
    that shuffle already (asking for their partitions would run them).
    """
    if df._jdf.queryExecution().executedPlan().nodeName().startswith("AdaptiveSparkPlan"):
        return df
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df
