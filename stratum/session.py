"""SparkSession construction and cluster-shared scratch locations."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every stratum job relies on. AQE re-plans joins and coalesces
# shuffle partitions at runtime; skew-join splits oversized join partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "stratum",
    extra_conf: dict | None = None,
) -> SparkSession:
    """Return (or create) a session with stratum's defaults.

    ``master`` is only applied when given (on a cluster the launcher sets it).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if master and master.startswith("local"):
        # local mode runs every task inside the driver JVM; its 1g default heap
        # turns concurrent jobs into GC storms. On a cluster the launcher sets it.
        conf["spark.driver.memory"] = os.environ.get("STRATUM_DRIVER_MEMORY", "12g")
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this must already be set to a shared location (HDFS, object
    store, NFS); it is read from the session (or the SparkContext, when set
    programmatically). Only when it is unset in a local session -- tests -- do we
    pick a fresh scratch directory under /tmp and register it; on a cluster that raises.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    sc = None
    try:
        sc = spark.sparkContext
        current = current or sc.getCheckpointDir()
    except Exception:  # noqa: BLE001 -- Spark Connect: no SparkContext
        pass
    if not current:
        if sc is None or not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="stratum-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        try:
            spark.conf.set("spark.checkpoint.dir", current)
        except Exception:  # noqa: BLE001 -- some deployments refuse runtime core-conf changes
            pass
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint into the shared checkpoint folder.

    Used where a plan would otherwise be re-evaluated several times; the
    materialized files survive executor loss (unlike a local checkpoint).
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def ship_code(spark: SparkSession) -> None:
    """Make ``stratum`` (and the repo's ``tools``) importable in executor Python workers.

    Functions run by ``mapInPandas`` / ``applyInPandas`` are pickled by
    reference to their modules, so executors must be able to import them. The
    packages are zipped once per SparkContext and distributed with
    ``addPyFile`` (Spark copies the archive to every executor). A no-op when
    already shipped.
    """
    import zipfile

    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 -- Spark Connect has no SparkContext
        sc = None
    holder = sc if sc is not None else spark
    if getattr(holder, "_stratum_code_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="stratum-code-"), "stratum_code.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for pkg in ("stratum", "tools"):
            base = os.path.join(root, pkg)
            for dirpath, _, names in os.walk(base):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(dirpath, n)
                        z.write(full, os.path.relpath(full, root))
    if sc is not None:
        sc.addPyFile(archive)
    else:
        spark.addArtifacts(archive, pyfile=True)
    holder._stratum_code_shipped = True
