"""Session helpers: a tuned local session for tests and the bench, and the
shared folder used to cut lineage.

Library operators never change session settings; only :func:`get_spark`
(tests, bench) does.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "convprep") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("CONVPREP_DRIVER_MEMORY", "16g"))
    )
    if os.environ.get("CONVPREP_NO_AUTO_BROADCAST"):
        # Plan shapes of large data: no size-based broadcast, shuffle joins.
        builder = builder.config("spark.sql.autoBroadcastJoinThreshold", "-1").config(
            "spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def recommended_conf(
    input_bytes: int,
    executors: int,
    cores_per_executor: int,
    target_partition_bytes: int = 1024**3,
) -> dict[str, str]:
    """Settings that keep tasks spill-friendly for an input of ``input_bytes``.

    Shuffle partitions are sized so one partition of the largest shuffle
    (token triples run about 2-3x the text) stays near
    ``target_partition_bytes``, with at least two waves of tasks. The dense index and the
    lookups take their bucket counts from this value. AQE coalesces small
    partitions and splits skewed join partitions at run time.
    """
    slots = max(1, executors * cores_per_executor)
    shuffle_bytes = 3 * input_bytes
    partitions = max(2 * slots, -(-shuffle_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(int(partitions)),
        "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_partition_bytes),
        # Written stages (dense index, sub-word rounds) are removed once unreferenced.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    The folder named by ``spark.checkpoint.dir`` is used as is. Without one a
    local session gets a private temporary folder (tests); on a cluster that
    would be another disk on each machine, so the call fails.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = sc.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="convprep-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def ship_package(spark: SparkSession) -> None:
    """Make ``convprep`` importable in executor Python workers (pandas UDFs,
    ``mapInPandas``): zip the package once per SparkContext and add it with
    ``addPyFile``, as ``--py-files`` would on a cluster."""
    import zipfile

    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no SparkContext on the client
        sc = None
    holder = sc if sc is not None else spark
    if getattr(holder, "_convprep_shipped", False):
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    fd, path = tempfile.mkstemp(prefix="convprep-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg_dir):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    if sc is not None:
        sc.addPyFile(path)
    else:
        spark.addArtifacts(path, pyfile=True)
    holder._convprep_shipped = True


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder, for written stages.
    The folders of an application are removed when its Python process ends."""
    app = f"{ensure_checkpoint_dir(spark).rstrip('/')}/convprep-scratch/{spark.sparkContext.applicationId}"
    if app not in _SCRATCH:
        _SCRATCH.add(app)
        atexit.register(_remove, spark.sparkContext, app)
    return f"{app}/{name}-{uuid.uuid4().hex}"


_SCRATCH: set[str] = set()


def _remove(sc, path: str) -> None:
    """Delete a folder through Spark's file system; a stopped gateway leaves it."""
    try:
        folder = sc._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(sc._jvm.org.apache.hadoop.conf.Configuration()).delete(folder, True)
    except Exception:
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a Parquet folder in the shared folder and read it back: cuts
    the lineage, survives the loss of executors, and later reads prune columns."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over the cluster's slots where Catalyst estimates it
    smaller than one scan partition per slot; larger inputs stay where they lie.

    For steps that do much work per row without a shuffle of their own: a file
    that cannot be split (one row group, one JSON document) would keep all of
    it in one task. The rows moved are bounded by slots x
    ``spark.sql.files.maxPartitionBytes``.
    """
    spark = df.sparkSession
    slots = spark.sparkContext.defaultParallelism
    one = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(slots) if slots > 1 and size < slots * one else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
