"""Session construction and shared-storage helpers.

On a cluster the session is built by the launcher; these helpers only fill in
settings that are unset (as in tests and the local benchmark).
"""

from __future__ import annotations

import os
import tempfile
import threading

from pyspark.sql import SparkSession

_LOCAL_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # one BLAS thread per Python worker: Spark already runs a task per core
    "spark.executorEnv.OMP_NUM_THREADS": "1",
    "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "rankfold") -> SparkSession:
    """Return the active session, or build a local one with sane defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in _LOCAL_DEFAULTS.items():
        builder = builder.config(k, v)
    if "spark.driver.memory" not in os.environ.get("PYSPARK_SUBMIT_ARGS", ""):
        builder = builder.config("spark.driver.memory", "8g")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session; only when it is unset (tests, local runs) a fresh
    scratch folder is created and registered.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
        if d:
            return d
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="rankfold-ckpt-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-path of the checkpoint folder for an intermediate table."""
    import uuid

    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


_SHIP_LOCK = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Make ``rankfold`` importable on executors (pandas UDF closures refer to
    its functions by module): zip the package once per SparkContext and add it
    with ``addPyFile``, which Spark distributes to every executor."""
    with _SHIP_LOCK:
        _ship(spark)


def _ship(spark: SparkSession) -> None:
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_rankfold_shipped", False):
        return
    import rankfold

    pkg = os.path.dirname(os.path.abspath(rankfold.__file__))
    root = os.path.dirname(pkg)
    path = os.path.join(tempfile.mkdtemp(prefix="rankfold-pkg-"), "rankfold.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    sc._rankfold_shipped = True


def spread(df, factor: int = 2):
    """Repartition an input that has fewer splits than the cluster has cores
    (small files feeding per-row heavy work such as tokenization). Inputs that
    are already split at least that finely -- every large input -- are left
    untouched, so no shuffle is added at scale."""
    par = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < par:
        return df.repartition(par * factor)
    return df
