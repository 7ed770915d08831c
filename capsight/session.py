"""Session construction for tests, the bench and command-line use.

Library functions never build a session; they take DataFrames. On a
cluster, pass the cluster's own session and keep its settings; here we only
fill in what is unset.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Settings that matter at scale: AQE re-plans joins from real sizes
# (broadcast only what turns out small, split skewed partitions), and
# coalesces the many small shuffle partitions of per-group outputs.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpointed small tables are removed once no DataFrame refers to them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cpus: int | str | None = None, shuffle_partitions: int | None = None,
                  app: str = "capsight", extra: dict | None = None) -> SparkSession:
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or cpus)
    conf["spark.driver.memory"] = os.environ.get("CAPSIGHT_DRIVER_MEMORY", "16g")
    if os.environ.get("CAPSIGHT_ROWINDEX_METHOD"):
        conf["capsight.rowindex.method"] = os.environ["CAPSIGHT_ROWINDEX_METHOD"]
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the session's checkpoint folder, setting one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is kept.
    Only a local test session gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset on a cluster session; "
                           "set it to a shared folder")
    path = fallback
    if path is None:
        path = tempfile.mkdtemp(prefix="capsight-ckpt-", dir="/tmp")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    sc.setCheckpointDir(path)
    return path


def scratch_dir(spark: SparkSession, prefix: str) -> str:
    """A fresh folder name under the session's shared checkpoint folder, for
    intermediate tables a job writes and reads back (never a machine-local
    temporary folder on a cluster)."""
    import uuid
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/capsight-{prefix}-{uuid.uuid4().hex[:12]}"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the Python workers once per application, so that
    functions run by ``mapInArrow`` resolve whether or not the package is
    installed on the executors."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    keep = tempfile.mkdtemp(prefix="capsight-code-")  # served by the driver, so it stays until exit
    atexit.register(shutil.rmtree, keep, ignore_errors=True)
    name = os.path.join(keep, "capsight_code.zip")
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(name)
    _SHIPPED.add(app)
