"""Session settings the operators are tuned for, and the checkpoint folder rule."""
from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cpus: int = 8, app: str = "pulsegrid", memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in SETTINGS.items():
        b = b.config(key, value)
    b = (b.config("spark.sql.shuffle.partitions", str(cpus))
          .config("spark.driver.memory", memory)
          .config("spark.ui.enabled", "false"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: With this setting a query's shuffle files go as it ends (Spark 4.1; without effect before), not when the driver happens to collect its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a batch that a task sends to its Python worker (Spark 4.1; without effect before).  The default is 64 MB, which JVM and worker both hold.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
LEAN = {FREE_SHUFFLES: "true", BATCH_BYTES: "8m"}


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """Queries made and run in here drop their shuffle files as they end and send rows to Python in batches of at most 8 MB."""
    before = {k: spark.conf.get(k, None) for k in LEAN}
    for k, v in LEAN.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut_lineage(df: DataFrame, free_shuffles: bool = False) -> DataFrame:
    """Checkpoint ``df`` in the folder the cluster names, so lost executors cost no replay.

    A temporary folder is used only where ``spark.checkpoint.dir`` is unset (tests).  ``free_shuffles`` runs it :func:`lean`, which
    drops the shuffle files that the checkpoint needed; a second run of ``df`` itself would make them again.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    if not free_shuffles:
        return df.checkpoint(eager=True)
    with lean(spark):
        return df.select("*").checkpoint(eager=True)      # a plan of its own, made under the settings


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per session, so that functions run there wherever the driver started."""
    sc = spark.sparkContext
    if getattr(sc, "_pulsegrid_sent", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="pulsegrid-"), "pulsegrid.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(target)
    sc._pulsegrid_sent = True
