"""Session helpers: a local test session and lineage cuts in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "headroom") -> SparkSession:
    """A single-machine session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; only a one-machine session without one (tests) gets its own.

    A cluster that names no folder is an error: a folder of one machine would hold a part of
    the rows of every written table.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not _one_machine(context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="headroom-checkpoint-"))


def _one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder of its own below the checkpoint folder, which every executor can reach.

    It is deleted when the session's process ends.
    """
    ensure_checkpoint_dir(spark)
    context = spark.sparkContext
    path = f"{context._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(context._jsc.hadoopConfiguration())
    _delete_at_exit(system, place)
    return path


def _delete_at_exit(system, place) -> None:
    """Only folders that exist can be marked; the mark stays when the writer makes its own."""
    system.mkdirs(place)
    system.deleteOnExit(place)
    system.delete(place, True)


#: Shuffle files of a finished write are of no more use: the written rows replace them.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table below the checkpoint folder and go on from there.

    Used where several passes read the same derived rows, for small tables whose size the
    optimizer should know before it chooses a join, and between the rounds of an
    iterative fit. The rows survive lost executors, are not computed again, and later
    passes read only the columns they need.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, "settled"), spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)
