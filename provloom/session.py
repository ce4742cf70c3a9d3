"""Session and table helpers."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

#: Folders of rounds that were written and not removed.
_ROUNDS: list[str] = []


def local_session(cpus: int | str = 8, app: str = "provloom", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use; clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a scale-factor folder; only Spark's reader touches the path, so any Hadoop store works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back.

    The lineage ends there, lost executors cost no round, and Spark's estimate of the result is the files' size, so that
    joins of rounds with each other are planned by what they hold.
    """
    folder = f"{shared_folder(df.sparkSession)}/round-{uuid.uuid4().hex}"
    _ROUNDS.append(folder)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def release_rounds(spark: SparkSession) -> None:
    """Removes the tables that ``checkpoint`` has written so far; results that read them must have been taken or written. It is done once more when Python ends."""
    while _ROUNDS:
        path = spark._jvm.org.apache.hadoop.fs.Path(_ROUNDS.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _release_at_end() -> None:
    spark = SparkSession.getActiveSession() if _ROUNDS else None
    if spark is not None:
        with contextlib.suppress(Exception):  # the JVM may be gone
            release_rounds(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or the one given to ``setCheckpointDir``. A temporary one
    takes its place in local mode only; elsewhere a missing folder is an error, as executors would not see it."""
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir"):
        return named
    given = sc._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="provloom-")
