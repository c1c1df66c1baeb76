"""Session defaults and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "corpusmill", cores: str | int = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the operators expect: UTC, ANSI and AQE on, Arrow transfer."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the session's spark.checkpoint.dir.

    Where that is unset, a run inside one machine (local[...]) gets a temporary folder, which all of its tasks can read; on a cluster an
    unset folder raises, since the executors of other machines couldn't read a temporary one.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    wanted = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not wanted:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can read")
        wanted = tempfile.mkdtemp(prefix="corpusmill-checkpoints-")
        atexit.register(shutil.rmtree, wanted, ignore_errors=True)
    context.setCheckpointDir(wanted)
    return wanted


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared checkpoint folder and go on from there; survives the loss of executors.

    A table is read again by column and compressed, where a checkpoint is neither. The tables of an application go when it ends; what is
    left after a crash goes with the cluster's folder.
    """
    spark = df.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/tables"
    if base not in _FOLDERS:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
        _FOLDERS.add(base)
    written = f"{base}/{uuid.uuid4().hex}"
    df.write.parquet(written)
    return spark.read.schema(df.schema).parquet(written)


_FOLDERS: set[str] = set()


def spread(df: DataFrame) -> DataFrame:
    """The rows of a scan over all cores when the files give fewer than half as many tasks (one small file), for work that is much heavier than reading.

    Larger inputs have more tasks than cores and stay as they are, so nothing is shuffled there. df must need no shuffle itself.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session (once for each application), so that they can import it from anywhere."""
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="corpusmill-")
    archive = os.path.join(folder, "corpusmill_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as zipped:
        for root, _, files in os.walk(package):
            for name in sorted(files):
                if name.endswith(".py"):
                    path = os.path.join(root, name)
                    zipped.write(path, os.path.join("corpusmill", os.path.relpath(path, package)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(application)
