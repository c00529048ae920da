"""Spark session helpers.

Cluster settings (shuffle partitions, checkpoint directory, memory) come from
the session the caller provides; the helpers here only fill in defaults where
a setting is unset, which is what local runs and tests need.
"""

from __future__ import annotations

import contextlib
import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

# Defaults applied only when the caller did not configure the session.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(master: str | None = None, app: str = "varietylens",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Local/test session builder. On a cluster, build the session with the
    cluster's own settings and pass it in instead."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.driver.memory", os.environ.get("VL_DRIVER_MEMORY", "16g")))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_defaults(spark)
    return spark


def apply_defaults(spark: SparkSession) -> None:
    for k, v in _DEFAULTS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, honouring the session's
    ``spark.checkpoint.dir``. A private temporary folder is created only for
    local masters (tests); on a cluster an unset directory is an error,
    because a machine-local folder would not survive executor loss."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder")
    path = tempfile.mkdtemp(prefix="vl-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder's URI (any store pyarrow knows)."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_varietylens_shipped", False):
        return
    top, packed = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(top.rglob("*.py")):
            z.writestr(str(f.relative_to(top.parent)), f.read_text())
    folder, name = ensure_checkpoint_dir(spark).rstrip("/"), f"varietylens-{uuid.uuid4().hex}.zip"
    fs, base = open_store(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
        out.write(packed.getvalue())
    sc.addPyFile(f"{folder}/{name}")
    sc._varietylens_shipped = True


def materialize(df: DataFrame, keep_partitioning: bool = False) -> DataFrame:
    """Cut lineage of a fitted/intermediate table; the copy lives in the
    shared checkpoint directory, so it survives executor loss.

    Default: write Parquet and read it back (one job; the optimizer then
    knows the real size, so small model tables are broadcast and big ones
    are not). ``keep_partitioning``: reliable RDD checkpoint, which keeps the
    hash partitioning of the frame (persisted first so the checkpoint write
    does not recompute the plan)."""
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    if keep_partitioning:
        from pyspark import StorageLevel
        cached = df.persist(StorageLevel.MEMORY_AND_DISK)
        out = cached.checkpoint(eager=True)
        cached.unpersist()
        return out
    global _SEQ
    _SEQ += 1
    path = f"{base.rstrip('/')}/vl-{uuid.uuid4().hex}-{_SEQ}"
    with _tidy(spark):
        df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


_SEQ = 0
# Spark's own setting: an execution's shuffle files go when it ends.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _tidy(spark: SparkSession):
    """What is shuffled for a table goes once it is written, as nothing reads it again."""
    before = spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(_TIDY, before)


def materialize_bucketed(df: DataFrame, col: str, buckets: int, placed: bool = False) -> DataFrame:
    """Write ``df`` as a table bucketed by ``col`` under the checkpoint
    folder and read it back. The scan reports hash partitioning on ``col``,
    so later aggregations / windows / joins keyed by ``col`` (plus other
    columns) run without another shuffle. ``placed``: ``df`` is partitioned by
    ``col`` into that many partitions already and is written as it lies."""
    global _SEQ
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    _SEQ += 1
    name = f"vl_{uuid.uuid4().hex}_{_SEQ}"
    with _tidy(spark):
        (df if placed else df.repartition(buckets, col)).write \
            .bucketBy(buckets, col).option("path", f"{base.rstrip('/')}/{name}").saveAsTable(name)
    return spark.table(name)
