"""Session defaults and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "webcorpus", **conf) -> SparkSession:
    """A session with the settings the operators are designed for.

    AQE coalesces small shuffle partitions and splits skewed join partitions, so the
    shuffle partition number only has to be an upper bound.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # HTML rows are wide: keep Arrow batches small enough for the Python workers.
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    )
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and stream state.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session without that
    setting gets a folder of its own (tests); a cluster without it is an error, because a
    machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    own = getattr(spark, "_webcorpus_dir", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="webcorpus-")
        spark._webcorpus_dir = own
    return own


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared folder and go on from there.

    The table survives the loss of any executor, is columnar, and its known size lets the
    next join choose a broadcast by itself when it is small.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), "tables", uuid.uuid4().hex)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Workspace:
    """Tables of one run, in a folder of their own below the shared one; leaving the context deletes them.

    Results that outlive the run are written outside, by ``cut_lineage``.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.names = spark, []
        self.folder = os.path.join(shared_dir(spark), "work", uuid.uuid4().hex)
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def store(self, df: DataFrame) -> DataFrame:
        path = os.path.join(self.folder, uuid.uuid4().hex)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, *keys: str) -> DataFrame:
        """Store rows by the hash of ``keys``: joins on them between tables of this workspace move no row."""
        name = f"work_{uuid.uuid4().hex}"
        out = df.repartition(self.buckets, *keys).write.format("parquet").bucketBy(self.buckets, *keys).sortBy(*keys)
        out.option("path", os.path.join(self.folder, name)).saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)


def stream_dir(spark: SparkSession, name: str) -> str:
    """A fresh checkpoint location for one run of a stream."""
    return os.path.join(shared_dir(spark), "streams", f"{name}-{uuid.uuid4().hex}")
