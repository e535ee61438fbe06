"""Session construction and the shared checkpoint location.

On a cluster the operator of the cluster sets ``spark.checkpoint.dir`` to a
shared, fault-tolerant folder (HDFS / object store).  We only ever *read* that
setting; a private folder is created only when it is unset on a local master
(tests); elsewhere the missing setting is an error.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def get_spark(master: str | None = None, app: str = "gridmap", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the jobs are tuned for.

    AQE is on so shuffle partitions coalesce for small inputs and skewed
    partitions are split at run time; the session time zone is UTC so
    timestamp formatting is deterministic.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    cpus = os.environ.get("BENCH_CPUS")
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        # broadcast only small dimension tables (vocabulary, configs, labels);
        # anything that grows with the data goes through a shuffle join.
        "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
        # per-row gathers (collect_list over one grid row) have many small groups: keep them in the
        # object hash map up to a bounded number of keys per task before falling back to sorting
        "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536",
        # joins on (doc_id, ...) may reuse a partitioning on doc_id alone (each document's rows are
        # bounded by configuration, so doc_id partitions cannot be skewed by one document)
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
    }
    if master and master.startswith("local"):
        conf["spark.driver.memory"] = "16g"
    if shuffle_partitions is None and cpus:
        shuffle_partitions = int(cpus) * 2
    if shuffle_partitions is not None:  # else the cluster's own setting holds
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    ship_package(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a private one only if unset.

    The folder is also registered as the SparkContext checkpoint directory so
    ``DataFrame.checkpoint()`` (reliable checkpoint, never ``localCheckpoint``)
    cuts lineage into storage that survives executor loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = sc.getConf().get(_CHECKPOINT_KEY, None)
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError(f"set {_CHECKPOINT_KEY} to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="gridmap-ckpt-")  # tests and single-machine runs
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def co_partition_by_document(spark: SparkSession) -> None:
    """Joins on (doc_id, ...) may reuse a partitioning on doc_id alone, also in sessions that ``get_spark`` did not build."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def gather_rows_by_hash(spark: SparkSession) -> None:
    """Gathers of the cells of a grid row (collect_list) stay in the hash map up to 65,536 rows a task instead of sorting all cells
    after 128; the corpus is partitioned into tasks of fewer."""
    spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "65536")


#: Documents whose header cells, matches and answers one task holds at most.
DOCUMENTS_PER_TASK = 5_000


def document_tasks(docs: DataFrame) -> int:
    """Partitions for tables with a few rows a document: in proportion to the documents, so that the memory of a task doesn't grow with them."""
    return max(-(-docs.count() // DOCUMENTS_PER_TASK), docs.sparkSession.sparkContext.defaultParallelism)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder as compressed Parquet and read back, so that readers take only the columns they need."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint: materialise ``df`` in the shared checkpoint dir."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=eager)


def ship_package(spark: SparkSession) -> None:
    """Make ``gridmap`` importable in Python workers (mapInPandas / applyInPandas tasks).

    The package is zipped once per SparkContext and added with ``addPyFile``,
    which distributes it to every executor through Spark itself.
    """
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_gridmap_shipped", False):
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="gridmap-pkg-"), "gridmap.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    sc._gridmap_shipped = True
