"""Session helpers."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so their Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    fd, path = tempfile.mkstemp(prefix="stratalex-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def local_session(app: str = "stratalex", cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """A session on this machine for tests and benchmarks; on a cluster the submitter's settings hold."""
    n = os.cpu_count() if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor can read and write.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a
    temporary folder is made for a local master only; elsewhere it would be
    another folder on each machine, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="stratalex-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


#: Spark's setting that deletes the shuffle files of a query when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends, or by ``drop_path`` before."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if not _MADE:
        # after Spark's own, so before them at the end
        atexit.unregister(_clean)
        atexit.register(_clean)
    _MADE[path] = spark
    return path


def materialize(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write ``df`` as a table in the shared folder; the table read back, and its path.

    This cuts the lineage: a later loss of an executor costs no more than a
    read of the table. The shuffle files of the query go as soon as the table is
    written, as nothing can ask for them any more.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


#: Tables that are still there; what is left of them goes when the driver ends.
_MADE: dict[str, SparkSession] = {}


def _clean() -> None:
    for path, spark in list(_MADE.items()):
        try:
            drop_path(spark, path)
        except Exception:  # the session may be gone; nothing else can be done at the end of the process
            return


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table that ``materialize`` wrote."""
    _MADE.pop(path, None)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` from a reliable checkpoint in the shared folder; it keeps its partitioning, so later groups by its keys need no shuffle."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    # an adaptive plan does not tell its partitioning before it has run, so the checkpoint would forget it
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        done = df.checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    del df
    collect_garbage(spark)
    return done


def collect_garbage(spark: SparkSession) -> None:
    """Shuffle files that nothing can need any more go when the driver's garbage does; a second round takes what the first one released."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


class Tables:
    """Intermediate tables of one operator: ``put`` writes one, ``drop`` deletes them all when a result is written."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[str] = []

    def put(self, df: DataFrame, tag: str) -> DataFrame:
        table, path = materialize(df, tag)
        self.paths.append(path)
        return table

    def drop(self) -> None:
        while self.paths:
            drop_path(self.spark, self.paths.pop())
