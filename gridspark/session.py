"""Session defaults and lineage cutting."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# HotSpot never compiles a method above 8,000 bytes of bytecode.  Evaluating many
# pedotransfer functions on one row exceeds that in a single fused method and is
# then interpreted, 2-3 times slower; below this limit Spark splits the code.
HUGE_METHOD, JIT_LIMIT, SPARK_DEFAULT = "spark.sql.codegen.hugeMethodLimit", "8000", "65535"
# Whether shuffle files go when the action that wrote them ends, and not when the driver happens to collect its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Partitions that a small step keeps at least.
SPREAD = 12


def tune(spark: SparkSession) -> None:
    """Apply the method limit to a session made elsewhere, unless it chose its own."""
    if spark.conf.get(HUGE_METHOD, SPARK_DEFAULT) == SPARK_DEFAULT:
        spark.conf.set(HUGE_METHOD, JIT_LIMIT)


def build_session(app: str = "gridspark", master: str | None = None, **conf) -> SparkSession:
    """Session with the settings the operators are written for.

    Nothing here fixes a cluster size: partition counts are left to adaptive
    execution, which coalesces small shuffles and splits skewed join inputs.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
        "spark.ui.enabled": "false",
        HUGE_METHOD: JIT_LIMIT,
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the session's checkpoint folder and drop its lineage.

    The folder is the one that the context has or the cluster names in
    ``spark.checkpoint.dir``.  A session without one keeps the rows in memory and
    on its disks instead: no folder is invented that executors might not share.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            return df.persist(StorageLevel.MEMORY_AND_DISK)
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Every action on a frame made inside removes its shuffle files at its end.

    Each action plans anew, so none reads what an earlier one shuffled.  A frame that is kept in memory keeps its own.
    """
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder that this session wrote, in whatever store it lies."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_stored(*frames: DataFrame) -> None:
    """Delete the checkpoint files of frames from :func:`cut_lineage` that nothing reads any more.

    Frames that a session without a checkpoint folder keeps in memory stay: what they lead to may not be computed yet.
    """
    for df in frames:
        plan = df._jdf.queryExecution().analyzed()
        if plan.getClass().getSimpleName() != "LogicalRDD":
            continue
        file = plan.rdd().getCheckpointFile()
        if file.isDefined():
            remove_folder(df.sparkSession, file.get())


def gathered(df: DataFrame, rows: int, each: int) -> DataFrame:
    """``df`` in a partition for ``each`` of its ``rows``, about, but no fewer than SPREAD and never more than it has.

    Every task costs an index, a block of disk and an entry in the logs, whatever it moves, so steps over few rows keep
    to few tasks.  A large table keeps all its partitions.
    """
    return df.coalesce(max(SPREAD, -(-rows // each)))


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: that of checkpoints, else the warehouse."""
    return (spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
            or spark.conf.get("spark.sql.warehouse.dir"))
