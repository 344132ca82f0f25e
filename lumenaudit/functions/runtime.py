"""Session helpers: the shared folder, cutting lineage, table access."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

#: Paths below the shared folder that this application has made and not yet deleted.
_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset, as in
    local tests, a temporary folder of this machine is used and remembered.
    """
    found = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lumenaudit-")
        spark.conf.set(CHECKPOINT_KEY, found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted by ``clean``, at the latest when the application ends."""
    path = f"{shared_dir(spark)}/lumenaudit/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def clean(spark: SparkSession) -> None:
    """Deletes what ``cut`` and ``scratch`` have left in the shared folder; results that still read it are then lost."""
    for path in [p for p, s in _made.items() if s is spark]:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _made.pop(path, None)


@atexit.register
def _clean_all() -> None:
    # the session may be gone: then the folder is the cluster's to clear
    with contextlib.suppress(Exception):
        for path, spark in list(_made.items()):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage, so a lost executor costs no recomputation of what came
    before. ``drop_cut`` removes the files when a loop no longer needs them.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again._lumen_path = path
    return again


def drop_cut(df: DataFrame) -> None:
    """Delete the files behind a DataFrame made by ``cut``; others are left alone."""
    path = getattr(df, "_lumen_path", None)
    if path:
        _delete(df.sparkSession, path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder: ``<folder>/<name>.parquet`` (a file or a folder of files)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    """Tasks that a wide stage should have: the session's shuffle partitions, at least one per core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)


#: Operators whose output is partitioned by a shuffle.
_WIDE = re.compile(r"^[\s:+|-]*(Join|Aggregate|Window|Sort|Distinct|Repartition|RepartitionByExpression|FlatMapGroupsInArrow|FlatMapGroupsInPandas|Intersect|Except)\b", re.M)


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Rows dealt evenly over the tasks when the input has fewer splits than the session has cores.

    A scan of many splits is left as it is, so no shuffle is paid at scale; so are tables
    that come out of a shuffle, as counting their parts would run it.
    """
    if _WIDE.search(df._jdf.queryExecution().optimizedPlan().toString()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *cols) if cols else df.repartition(cores)
