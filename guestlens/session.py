"""Session settings and shared working folders."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the engine relies on.  Times are shown as "... UTC", so the session
# time zone must be UTC; AQE re-plans joins at run time and splits skewed
# partitions of sort-merge joins.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
}
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Coalesce shuffle partitions to the advisory size instead of keeping
    # parallelism: fewer tiny tasks on shared clusters.
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    # Groups that a task collects lists of before it sorts its rows instead; Spark's own 128 sorts nearly always.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "10000",
}
# What one task takes at most, in compressed bytes.  Sorted or repeated values shrink to a fiftieth and less, and
# a sort or an aggregate holds them unpacked, so Spark's own 64 and 128 MB become gigabytes in one
# task.  Larger settings are lowered.
MOST_BYTES = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": 4 * 2**20,
    "spark.sql.files.maxPartitionBytes": 16 * 2**20,
}


def size_bytes(setting: str) -> int:
    """Bytes of a size as Spark writes it: "64m", "64MB", "67108864b" or "67108864"."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)b?", setting.strip().lower()).groups()
    return int(number) * 1024 ** " kmgtp".index(unit or " ")


def partition_settings(input_bytes: int, cores: int, target_bytes: int = 256 * 2**20,
                       expansion: float = 2.0, max_partitions: int = 100_000) -> dict[str, str]:
    """Scan and shuffle sizes so each task's partition fits executor memory.

    Shuffle partitions ~ input x expansion (text -> exploded mentions) /
    target, at least two per core; when that exceeds ``max_partitions`` the
    target grows instead (so 100 TB gives 100,000 partitions of ~2 GiB input
    shuffle each, which Tungsten sorts with spill).  AQE then coalesces small
    partitions toward the target and splits skewed join partitions."""
    n = max(2 * cores, math.ceil(input_bytes * expansion / target_bytes))
    if n > max_partitions:
        target_bytes = math.ceil(input_bytes * expansion / max_partitions)
        n = max_partitions
    return {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(n),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(min(target_bytes, 1024 * 2**20)),
        "spark.sql.files.maxPartitionBytes": str(min(target_bytes, 1024 * 2**20)),
    }


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "guestlens", extra: dict | None = None,
                  input_bytes: int | None = None, cores: int = 8) -> SparkSession:
    """Session for tests, the bench and local runs (UI off, no extra ports).  With
    ``input_bytes`` the scan and shuffle sizes come from ``partition_settings``."""
    b = (SparkSession.builder.master(master).appName(app_name)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "8g")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    sizes = partition_settings(input_bytes, cores) if input_bytes is not None else {}
    for k, v in {**REQUIRED_CONF, **DEFAULT_CONF, **sizes, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the engine needs to an existing session."""
    for k, v in REQUIRED_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    for k, v in DEFAULT_CONF.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    for k, most in MOST_BYTES.items():
        if size_bytes(spark.conf.get(k)) > most:
            spark.conf.set(k, str(most))
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, with its scheme.

    On a cluster this setting must name storage that every node sees; without it
    this raises.  Only a local master, where driver and executors are one process,
    gets a private folder.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - sessions without a SparkContext (Connect)
        sc = None
    d = spark.conf.get("spark.checkpoint.dir", None)
    if sc is not None:
        d = d or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if sc is None or not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        d = tempfile.mkdtemp(prefix="guestlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def work_path(spark: SparkSession, *parts: str, fresh: bool = True) -> str:
    """A folder under the shared checkpoint root for landed files and tables
    (Spark's writers create it)."""
    root = checkpoint_root(spark).rstrip("/")
    leaf = "/".join(parts)
    if fresh:
        leaf = f"{leaf}-{uuid.uuid4().hex[:12]}"
    return f"{root}/guestlens/{leaf}"
