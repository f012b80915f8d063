"""Session set-up, table access and lineage cutting shared by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the executors, unless PYTHONPATH already does."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parent
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    if str(root.parent) not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        archive = os.path.join(tempfile.mkdtemp(prefix="skein-"), f"{root.name}.zip")
        try:
            with zipfile.PyZipFile(archive, "w") as z:  # compiled, so that workers start as fast as from a folder
                z.writepy(str(root))
        except OSError:  # the folder can't be written to
            shutil.make_archive(archive.removesuffix(".zip"), "zip", root.parent, root.name)
        sc.addPyFile(archive)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows over at least as many partitions as there are cores.

    For work that costs far more than moving its rows once: a scan of few, small files would
    keep most cores idle. A scan with enough splits, as of any large table, is left alone; so is a frame
    behind a shuffle, which has set its partitions already.
    """
    if _shuffles(df._jdf.queryExecution().executedPlan()):
        return df  # asking for its partitions would run it
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def _shuffles(plan) -> bool:
    """Whether a physical plan has a shuffle, by the kinds of its nodes; adaptive execution wraps such plans."""
    kind = plan.getClass().getSimpleName()
    children = plan.children()
    return kind in ("AdaptiveSparkPlanExec", "ShuffleExchangeExec") or any(_shuffles(children.apply(i)) for i in range(children.size()))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``. Only on a local master, where it may be unset as in
    tests, a temporary folder takes its place, which is deleted when the program ends."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="skein-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        named = "file://" + folder
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint: the rows are written to the shared folder and the lineage ends there."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager)


def written(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Like :func:`cut`, but as a Parquet table, so later reads prune columns."""
    spark = df.sparkSession
    place = os.path.join(shared_dir(spark), f"skein-{uuid.uuid4().hex}")
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(place)
    return spark.read.parquet(place)
