"""Where plans are cut: shared tables that outlive a lost executor, and sensible task counts.

``stage`` writes a DataFrame once, as Parquet, to the folder that all executors share (``spark.checkpoint.dir``) and
reads it back. Unlike a local checkpoint nothing is held by a single executor, and unlike ``checkpoint()`` the last
stage runs only once. Only where the session names no folder and is local (tests) a temporary one is made; on a cluster that is an error.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's folder for intermediate tables, below the shared folder the cluster names."""
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="tracelake-")
            spark.sparkContext.setCheckpointDir(base)
        _OWN[app] = f"{base.rstrip('/')}/tracelake-{uuid.uuid4().hex}"
        atexit.register(clear, spark)
    return _OWN[app]


def clear(spark: SparkSession) -> None:
    """Delete the session's intermediate tables; results that still read them become invalid."""
    try:
        path = _OWN.pop(spark.sparkContext.applicationId, None)
        if path:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        pass


def stage(df: DataFrame, name: str = "t") -> DataFrame:
    """Compute once into a shared table and read it back (cuts the lineage)."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete tables of ``stage`` that nothing reads any more."""
    for t in tables:
        jvm, spark = t.sparkSession.sparkContext._jvm, t.sparkSession
        p = jvm.org.apache.hadoop.fs.Path(t._staged)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def tasks(spark: SparkSession) -> int:
    """Number of tasks for work bound by CPU: the shuffle partitions, but at least three waves of the cores."""
    return max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def parallel(df: DataFrame) -> DataFrame:
    """The scan as it is where it has enough splits for the cores, else spread evenly (as a single small file needs for work bound by CPU)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(tasks(df.sparkSession))


def spread(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Hash-partition by ``keys`` into a fixed number of tasks that adaptive execution doesn't coalesce."""
    return df.repartition(tasks(df.sparkSession), *keys)
