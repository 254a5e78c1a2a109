"""SparkSession construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()

# Settings every session built by get_session gets; ``extra`` overrides them.
_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Delete checkpoint files once the checkpointed frame is garbage-collected.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def default_parallelism(spark: SparkSession) -> int:
    """Cores available to the session (falls back to the shuffle partition count)."""
    try:
        return spark.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001 — Spark Connect has no SparkContext
        return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def get_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "strata",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Build (or reuse) a session with the toolkit defaults.

    On a cluster ``master`` stays ``None`` so spark-submit decides; tests
    pass ``local[*]`` and a small shuffle partition count.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins. Only when it is unset (local tests)
    do we create a scratch folder, so a job never writes lineage-cutting
    checkpoints to a machine-local path on a real cluster.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 — Spark Connect: the server owns the checkpoint folder
        return spark.conf.get("spark.checkpoint.dir", "") or ""
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not configured:
        if not sc.master.startswith("local"):
            # Executors cannot share a machine-local folder: refuse rather than
            # write checkpoints nobody else can read back.
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster (HDFS, S3, …)")
        # Unset in local mode (tests): a scratch folder on this machine is enough.
        configured = tempfile.mkdtemp(prefix="strata-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors once per application, for
    operators whose tasks run Python."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="strata-src-"), f"{root.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)
