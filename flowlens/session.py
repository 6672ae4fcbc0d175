"""Spark session defaults and the shared checkpoint location."""

from __future__ import annotations

import gc
import hashlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings every job in the library relies on: UTC wall clock (time-of-day
# features and ISO parsing), AQE for skew and partition coalescing.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # parse each JSON line once: the JSON-expression rewrite would otherwise
    # re-run from_json with a pruned schema for every extracted field
    "spark.sql.optimizer.enableJsonExpressionOptimization": "false",
    # the JVM never compiles a method of more than 8,000 bytes; the long rule chains run
    # faster as one projection after the other than as one such method
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "flowlens") -> SparkSession:
    """Session for tests and the bench; on a cluster use the provided session."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.ui.enabled", "false")
    builder = builder.config("spark.ui.showConsoleProgress", "false")
    builder = builder.config("spark.driver.memory", os.environ.get("FLOWLENS_DRIVER_MEM", "16g"))
    for k, v in SESSION_DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that value
    always wins. Only when nothing is configured (local tests) a scratch
    folder is created.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # remote (Connect) session: the server owns the folder
        return spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="flowlens-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def default_parallelism(spark: SparkSession) -> int:
    """Cluster cores (classic sessions) or the shuffle-partition setting."""
    try:
        return int(spark.sparkContext.defaultParallelism)
    except Exception:
        return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Apply the SQL defaults to an existing session (e.g. the driver's)."""
    for k, v in SESSION_DEFAULTS.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on a running session
            pass
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


#: applications that have the package (this process)
_SHIPPED: set[str] = set()


def package_zip() -> str:
    """The package's modules as a zip file on the driver, named by their content."""
    here = os.path.dirname(os.path.abspath(__file__))
    found = sorted(os.path.join(d, n) for d, _, names in os.walk(here) for n in names if n.endswith(".py"))
    digest = hashlib.sha256()
    for path in found:
        digest.update(path.encode() + b"\0" + open(path, "rb").read())
    out = os.path.join(tempfile.mkdtemp(prefix="flowlens-"), f"flowlens-{digest.hexdigest()[:12]}.zip")
    with zipfile.ZipFile(out, "w") as z:
        for path in found:
            z.write(path, os.path.relpath(path, os.path.dirname(here)))
    return out


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application: functions that run in
    tasks go by reference, so what a module remembers lives once per worker process.
    Spark copies the file from the driver to every executor, late ones too."""
    try:
        sc = spark.sparkContext
    except Exception:  # remote session
        name = f"{id(spark)}"
        if name not in _SHIPPED:
            spark.addArtifacts(package_zip(), pyfile=True)
            _SHIPPED.add(name)
        return
    if sc.applicationId not in _SHIPPED:
        sc.addPyFile(package_zip())
        _SHIPPED.add(sc.applicationId)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory (never machine-local
    on a cluster: the checkpoint directory is the cluster's shared folder)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/flowlens-{name}-{uuid.uuid4().hex[:12]}"


def drop_folders(spark: SparkSession, *paths: str) -> None:
    """Delete folders that no plan reads any more, through Spark's file systems, and let Spark
    clean up the shuffle files of the jobs before. A remote session cannot and leaves them."""
    jvm = getattr(spark, "_jvm", None)
    if jvm is None:
        return
    for path in paths:
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    gc.collect()
    jvm.System.gc()


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, asked through Spark's file systems."""
    try:
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        return True
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise
