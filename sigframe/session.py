"""Session helpers: table access and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``root`` (a file or a folder of part files)."""
    return spark.read.parquet(f"{root}/{name}.parquet")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers of this application the package, once; they need not have it installed.

    The driver serves the archive to the executors, so no folder has to be shared.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="sigframe-"), "sigframe_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and temporary tables, shared by all executors.

    A folder already set on the context, or named by ``spark.checkpoint.dir`` in the
    session, is used as it is. Only where neither is set (local runs and tests) is
    one made.
    """
    jsc = spark.sparkContext._jsc.sc()
    current = jsc.getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sigframe-ckpt-")
    spark.sparkContext.setCheckpointDir(folder)
    return jsc.getCheckpointDir().get()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared checkpoint folder for a table written once."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{label}-{uuid.uuid4().hex}")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    Unlike a checkpoint, the table keeps column pruning and filter pushdown, so that
    several consumers each read only what they need. It is deleted when the driver ends.
    """
    return written_at(df, label)[0]


def written_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As ``written``, with the path of the table."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    fs, place = _filesystem(spark, path)
    fs.deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path), path


def _filesystem(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more; tables that are still read go when the driver ends."""
    fs, place = _filesystem(spark, path)
    fs.delete(place, True)
