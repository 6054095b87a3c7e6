"""Session set-up and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: str = "*", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]").appName("rentlens")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        b = b.config(key, value)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Spark's own switch for removing the shuffle files of a query when it ends, not when the driver collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. Where none is set, a
    local session, as in tests, takes a fresh folder; on a cluster that is an error,
    since executors would each write to a disk of their own."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = sc._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else _local_folder(spark)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return folder


def _local_folder(spark: SparkSession) -> str:
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="rentlens-")


def work_folder(spark: SparkSession) -> str:
    """The session's own folder below the checkpoint folder. The driver removes it when it ends."""
    folder = f"{checkpoint_folder(spark)}/rentlens-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows written as a table to the shared checkpoint folder and read back.

    Like a reliable checkpoint it survives the loss of executors; being parquet, it is
    read column by column and its size is known when joins are planned. The shuffle files of
    the write go when it ends, since the stored rows stand for them.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(*tables: DataFrame) -> None:
    """Removes tables of ``cut_lineage`` (frames as it returned them) that nothing will read any more."""
    for df in tables:
        own = work_folder(df.sparkSession)
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            if path.getParent().getName() == own.rsplit("/", 1)[-1]:
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a join's or a sort's task, above which an input is dealt to more tasks than the session's shuffles have.
TASK_ROWS = 1_000_000


def spread(df: DataFrame, rows: int, *keys: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """The rows dealt by their keys to tasks of about ``task_rows`` of ``rows`` rows, so that a task's memory does not
    grow with the input; left as they are where the session's shuffles have as many tasks. Inputs of a join are
    given the same ``rows``."""
    tasks = -(-rows // task_rows)
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
