"""A Spark session with the settings the engine is written for, and tables of the folder that its executors share."""

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch on its way to Python.
BATCH_BYTES = 4 << 20
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def session(master: str | None = None, shuffle_partitions: int | None = None, **settings: str) -> SparkSession:
    """UTC, adaptive execution, Arrow. Cluster sizing is left to the cluster unless given here."""
    builder = SparkSession.builder.appName("vellum")
    if master:
        builder = builder.master(master)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.showConsoleProgress": "false"}
    if shuffle_partitions:
        fixed["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in (fixed | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(scan: DataFrame) -> DataFrame:
    """In a local session, a file scan dealt to all cores, if it has fewer splits than there are cores (one small file, say). For plain scans only: on a cluster, splits follow from the files' sizes and no table is shuffled for this."""
    if not scan.sparkSession.sparkContext.master.startswith("local"):
        return scan
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan._jdf.queryExecution().toRdd().getNumPartitions() < cores else scan


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES bytes, whatever the length of texts: the 64 MB of Spark's default cost several hundred MB an executor.

    Spark reads the setting when a plan runs, so it stays lowered; results don't depend on it, and a lower one is left alone.
    """
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(ARROW_BYTES)) > BATCH_BYTES:
        spark.conf.set(ARROW_BYTES, BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's checkpoint folder, set here only if unset. What this application leaves there goes when it ends."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = sc.getConf().get("spark.checkpoint.dir")
        if configured is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            configured = tempfile.mkdtemp(prefix="vellum-checkpoint-")
        sc.setCheckpointDir(configured)
    own = sc.getCheckpointDir()  # a folder of this application's own within the configured one
    if own not in _CLEANED:
        _CLEANED.add(own)
        atexit.register(_remove, spark, own)
    return own


_CLEANED: set[str] = set()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Like cut(), but as a Parquet table of the shared folder, for wide rows that are read by column."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vellum-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete stored() tables of which nothing that is still to run reads."""
    for table in tables:
        _remove(table.sparkSession, table._stored_at)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended; the folder is the cluster's to clean then
        return
