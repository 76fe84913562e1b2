"""Session helpers: one place for the settings every query relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_PREPARED: set[int] = set()


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "constella") -> SparkSession:
    """Build (or reuse) a session with the settings the engine expects.

    On a cluster ``master`` is left to spark-submit; tests pass ``local[*]``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:  # otherwise the deployment's own setting holds
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master and master.startswith("local["):
        b = b.config("spark.driver.memory", "12g")
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Idempotent runtime settings: UTC session time, AQE, checkpoint dir."""
    key = id(spark)
    if key in _PREPARED:
        return spark
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    checkpoint_dir(spark)
    # Python callables shipped to executors (pandas UDFs, applyInPandas) are
    # pickled with their code, so executors need no installed copy of us.
    import constella
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(constella)
    _PREPARED.add(key)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment and must be shared storage;
    only when it is unset (tests, a laptop) do we pick a fresh local folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="constella-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/constella/{name}-{uuid.uuid4().hex[:12]}"


def ensure_parallelism(df, minimum: int | None = None):
    """Spread an under-partitioned frame (e.g. one large file with a single
    row group) over the cluster before iterative work reuses it. A frame that
    already has enough partitions is returned as is: no extra shuffle at
    scale."""
    want = minimum or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < want:
        return df.repartition(want)
    return df


def stage(df, step: int, every: int = 3):
    """Materialise one step of an iterative job: cached (recomputable from a
    short lineage if an executor is lost), and every ``every`` steps written
    as a reliable checkpoint so the lineage never grows with the iterations."""
    if step % every == every - 1:
        return cut_lineage(df)
    return df.persist()


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint (never localCheckpoint): survives executor loss."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def settle(df):
    """Writes a step of a long job to the shared folder and reads it back: the
    next step starts from a file scan, so neither plans nor the closures of
    earlier steps travel with its tasks, and a lost executor costs a read."""
    spark = df.sparkSession
    path = shared_dir(spark, "step")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
