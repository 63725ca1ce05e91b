"""Session defaults and the shared folder for checkpoints and stream state."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


# Settings that the operators count on where keys are skewed or state is large. All
# of them can be set at run time.
RUNTIME = {
    # timestamps without zone are compared with instants in places
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join partition even if what follows then needs another shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # merge the sessions of a hot key before the shuffle
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # keep stream state on disk with changelogs in the checkpoint, not on the heap
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def apply_runtime(spark: SparkSession) -> None:
    """Set the run-time settings on a session that came from elsewhere."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)


def get_session(app: str = "corpuswarden", master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC, adaptive execution and skew-join splitting on.

    The number of shuffle partitions is left to the cluster unless given:
    adaptive execution coalesces small ones.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        **RUNTIME,
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named in ``spark.checkpoint.dir``.

    Only where the session names none (single-machine tests) is a temporary
    folder made and remembered in that same setting.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("name a folder all executors share in spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="corpuswarden-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, label: str, counted: Column | None = None) -> tuple[DataFrame, int]:
    """Write ``df`` below the shared folder and read it back, with its row count, or the
    number of rows that hold ``counted``, told by the same job.

    Cuts the lineage like a checkpoint, but computes the plan only once. The
    files survive the loss of any executor."""
    stages = Stages(df.sparkSession, label)
    return stages.add(df, counted)


class Stages:
    """Results of an iterative operator, each round written as a table of its own
    and all of them readable together as one scan."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.paths, self.schema = spark, fresh_path(spark, label), [], None

    def add(self, df: DataFrame, counted: Column | None = None) -> tuple[DataFrame, int]:
        """Write one round; returns it as read back, and its row count or that of ``counted``."""
        path, seen = f"{self.root}/{len(self.paths)}", Observation()
        df.observe(seen, F.count(F.lit(1) if counted is None else F.when(counted, 1)).alias("n")).write.parquet(path)
        self.paths.append(path)
        self.schema = df.schema
        return self.spark.read.schema(self.schema).parquet(path), seen.get["n"]

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)
