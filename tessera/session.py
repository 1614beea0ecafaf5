"""Session helpers: reading a table set and cutting lineage durably."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Rows of a batch that Spark hands to Python where the user has not set it: texts are long, and Spark's 10,000 of them are many megabytes.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000


def prepare(spark: SparkSession) -> None:
    """Make batches for Python small, and send this package to the Python workers, unless they find it as the driver's own PYTHONPATH or working folder has it."""
    if BATCH not in spark.conf.getAll:
        spark.conf.set(BATCH, BATCH_ROWS)
    root = Path(__file__).resolve().parents[1]
    sc = spark.sparkContext
    found = {Path(p).resolve() for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p}
    if root in found or getattr(sc, "_tessera_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="tessera-package-")) / "tessera_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.joinpath("tessera").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(path))
    sc._tessera_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that ``spark.checkpoint.dir`` names. Where none is set, a session in one process gets a folder of its own; any other fails, as executors share no local folder."""
    prepare(spark)
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tessera-checkpoint-"))


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder now and return a frame that reads it.

    Later jobs neither recompute what stands above nor lose it with an executor. Spark's cleaner takes
    the files away if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set; else they stay, as
    checkpoints do. Keep the rows slim: checkpoint files are not compressed.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet to the shared folder; the frame that reads it, and its path."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table that ``stored`` has written."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
