"""Session helpers: UTC time zone, a shared scratch folder, a local session for tests and the bench."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

UTC = "UTC"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "capindex") -> SparkSession:
    """A local[N] session configured the way the library expects (tests, bench, smoke runs)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", UTC)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ensure_utc(spark: SparkSession) -> None:
    """Capture dates are UTC instants (CDX timestamps carry no zone); formatting and year/day buckets
    must be computed in UTC, so the library pins the session time zone."""
    if spark.conf.get("spark.sql.session.timeZone", None) != UTC:
        spark.conf.set("spark.sql.session.timeZone", UTC)


def _context(spark: SparkSession):
    """The SparkContext, or None for sessions without one (e.g. Spark Connect)."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001
        return None


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster (``spark.checkpoint.dir`` or the context's checkpoint dir).

    Only when neither is set and the master is local (tests, a laptop) a private folder is created and registered, so
    later ``checkpoint()`` calls and written tables land in the same place. On a cluster that would be a folder that
    the executors don't see, so it is an error.
    """
    sc = _context(spark)
    d = sc.getCheckpointDir() if sc is not None else None
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = sc.master if sc is not None else spark.conf.get("spark.master", "")
        if not re.match(r"local(\[.*)?$", master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="capindex-")
        if sc is not None:
            sc.setCheckpointDir(d)
        else:
            spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def default_parallelism(spark: SparkSession) -> int:
    """Task slots of the cluster (falls back to the shuffle partition count)."""
    sc = _context(spark)
    if sc is not None:
        return sc.defaultParallelism
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never-reused path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def is_local_path(path: str) -> bool:
    return "://" not in path or path.startswith("file:")


def local_fs_path(path: str) -> str:
    return path[len("file:"):] if path.startswith("file:") else path


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop FileSystem of the path (works for any cluster URI)."""
    if is_local_path(path):
        return os.path.exists(local_fs_path(path))
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


_SCRATCH = re.compile(r".+-[0-9a-f]{12}$")


def clean_scratch(spark: SparkSession, older_than_seconds: float = 7 * 86400) -> list[str]:
    """Remove scratch tables (see :func:`scratch_path`) of the shared folder that have not changed for that long, and return
    them. A result that still reads one must not be that old; other folders stay."""
    from .sources import files
    root = shared_dir(spark)
    found = [f"{root}/{n}" for n in files.names(spark, root) if _SCRATCH.match(n)]
    gone = sorted(p for p in found if files.age_seconds(spark, p) >= older_than_seconds)
    for p in gone:
        files.delete(spark, p)
    return gone
