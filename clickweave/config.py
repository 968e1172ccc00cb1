"""Session settings and the shared folder used for persisted tables and checkpoints."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job assumes. UTC matters: dates, hours and weeks are UTC in the
# source model, and streaming casts wall-clock event times to instants.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # stateful streaming keeps its keys on disk, not in executor heap
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "clickweave", extra: dict | None = None) -> SparkSession:
    """Session for tests and benchmarks. Cluster jobs bring their own session."""
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(SESSION_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def scale_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Shuffle and scan sizing for a job reading ``input_bytes`` on ``total_cores`` cores.

    Every heavy step here is one shuffle of (at most) the input volume, partially aggregated
    before it, so the initial shuffle partition count is the input over the target size,
    at least twice the cores; AQE coalesces small partitions and splits skewed ones after
    each stage. Scans use the same target split size.
    """
    parts = max(2 * total_cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": str(target_partition_bytes // 8),
    }


#: Bytes of a compressed event table that one task reads. Sorted, or grouped by user under three grouping sets,
#: the rows of a split take some twenty times its bytes of memory.
SPLIT_BYTES = 24 << 20
#: Bytes of a shuffle that adaptive execution packs into one task, compressed; a join's task sorts both its sides and
#: then what it writes.
PACKED_BYTES = 32 << 20
_UNITS = {"": 0, "b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30, "t": 40, "tb": 40}


def _bytes(value: str) -> int:
    number, unit = re.fullmatch(r"(\d+)([a-z]*)", value.strip().lower()).groups()
    return int(number) << _UNITS[unit]


def packed_bytes(spark: SparkSession) -> int:
    """Bytes of a shuffle that adaptive execution packs into one task."""
    return _bytes(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes"))


def bound_tasks(spark: SparkSession, input_bytes: int) -> None:
    """Keep what a task holds the same however large the input is: no split over SPLIT_BYTES (by default
    splits grow with a table up to 128 MB, and their rows spill), no task packed over PACKED_BYTES, and so many
    partitions before adaptive execution packs them that none passes that (by default a shuffle has 200, whatever
    its size; the widest moves about five times the bytes of the driver tables). Lower settings of the session stay."""
    for key, most in (("spark.sql.files.maxPartitionBytes", SPLIT_BYTES), ("spark.sql.adaptive.advisoryPartitionSizeInBytes", PACKED_BYTES)):
        if _bytes(spark.conf.get(key)) > most:
            spark.conf.set(key, str(most))
    parts = -(-5 * input_bytes // packed_bytes(spark))
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(parts))


def _context(spark: SparkSession):
    try:
        return spark.sparkContext
    except Exception:  # Spark Connect: no SparkContext on the client
        return None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as is. Only a local
    master may leave it unset (tests): a private folder is created and registered. Elsewhere a
    folder of the driver's machine would be out of the executors' reach, so that is an error.
    """
    sc = _context(spark)
    if sc is not None:
        current = sc.getCheckpointDir()
        if current:
            return current
        configured = sc.getConf().get("spark.checkpoint.dir")
        if configured:
            sc.setCheckpointDir(configured)
            return sc.getCheckpointDir()
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        local = tempfile.mkdtemp(prefix="clickweave-ckpt-")
        sc.setCheckpointDir(local)
        return sc.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise RuntimeError("spark.checkpoint.dir must name a shared folder")
    return configured


def shared_root(spark: SparkSession) -> str:
    """Folder (inside the checkpoint folder) holding tables this library writes."""
    return ensure_checkpoint_dir(spark).rstrip("/") + "/clickweave"


def new_shared_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused location under the shared root."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def local_path(path: str) -> str | None:
    """Filesystem path for ``file:`` URIs, None for remote stores."""
    if path.startswith("file:"):
        return path[len("file:"):]
    if "://" not in path and os.path.isabs(path):
        return path
    return None


def delete_path(spark: SparkSession, path: str) -> bool:
    """Remove a folder or file that this library wrote, in whatever store it is."""
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True))


def list_path(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in whatever store it is; none if it is absent."""
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(sc._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []


def path_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of a folder's files, in whatever store it is."""
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    return int(target.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(target).getLength())
