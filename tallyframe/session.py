"""Session factory and shared-folder helpers.

Settings are chosen for a cluster first: AQE on (coalescing, skew-join splitting,
runtime broadcast conversion), UTC session time, ANSI left on. ``local`` masters
only shrink the shuffle partition count.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings applied to every session we create. They are also safe on a large
# cluster: AQE re-plans joins at runtime, splits skewed shuffle partitions and
# coalesces small ones, so one partition count does not have to fit every stage.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # Static broadcast only for sides Catalyst can prove small; AQE re-checks at
    # runtime with the measured size of the finished shuffle stage.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpointed intermediates are removed by Spark once no longer referenced.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Settings for the 100 TB target (about 1000 executors). Shuffles start with many
# partitions and AQE coalesces them towards the advisory size, so one stage neither
# spills from oversized partitions nor drowns in tiny ones; skewed partitions above
# the threshold are split; executors being lost hand their shuffle blocks over first
# (decommissioning), and large streaming state lives in RocksDB, checkpointed to the
# shared folder.
CLUSTER_PROFILE = {
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": str(64 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * 1024 * 1024),
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.decommission.enabled": "true",
    "spark.storage.decommission.enabled": "true",
    "spark.storage.decommission.shuffleBlocks.enabled": "true",
    "spark.storage.decommission.rddBlocks.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.parquet.aggregatePushdown": "true",
}


def get_session(master: str | None = None, app: str = "tallyframe",
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None, profile: str | None = None) -> SparkSession:
    """Create (or reuse) a SparkSession with the library's settings.

    ``master`` is left to spark-submit when None. ``profile="cluster"`` adds
    ``CLUSTER_PROFILE`` (the 100 TB settings); ``shuffle_partitions`` overrides the
    partition count (pass the core count for local runs). ``spark.checkpoint.dir``
    must name a shared folder on a cluster (see ``checkpoint_root``).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if profile == "cluster":
        conf.update(CLUSTER_PROFILE)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    # Runtime SQL settings also apply when the session already existed.
    for k, v in conf.items():
        if k.startswith("spark.sql.") and k != "spark.sql.catalogImplementation":
            try:
                spark.conf.set(k, v)
            except Exception:  # static conf of an existing session
                pass
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints, stream state and intermediate tables.

    Read from the session (``spark.checkpoint.dir`` or the context's checkpoint
    dir). Only a ``local`` master without one gets a private temporary folder, as
    in tests; a cluster without a shared folder is an error, never a local path.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server's checkpoint folder applies
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            raise RuntimeError("spark.checkpoint.dir is not set; point it at a folder shared by all executors") from None
        return shared
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a folder shared by "
                "all executors (HDFS/S3/ABFS) before running tallyframe jobs")
        conf_dir = tempfile.mkdtemp(prefix="tallyframe-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def materialize(df):
    """Cut the lineage of an intermediate that several branches reuse.

    A reliable ``checkpoint`` into the shared folder: computed once, read back by each
    branch, and not lost with an executor (never ``localCheckpoint``).
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-folder of the shared checkpoint root."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


# Rows and (compressed) bytes that one task sorts or reads inside ``sized_tasks``.
TASK_ROWS, TASK_BYTES = 250_000, 16 << 20


@contextmanager
def sized_tasks(spark: SparkSession, rows: int):
    """What runs inside is cut into tasks by its ``rows`` of input, so that a task's sorts hold no more of a larger
    table. The session's number of shuffle partitions is kept where it is larger; AQE joins small ones again."""
    partitions = "spark.sql.shuffle.partitions"
    wanted = {partitions: str(max(int(spark.conf.get(partitions)), -(-rows // TASK_ROWS))),
              "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(TASK_BYTES),
              "spark.sql.files.maxPartitionBytes": str(TASK_BYTES)}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def is_local(spark: SparkSession) -> bool:
    try:
        return spark.sparkContext.master.startswith("local")
    except Exception:
        return False


def default_sf_dir() -> str:
    return os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
