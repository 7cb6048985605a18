"""Session settings that the operators are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # keeps streaming state off the heap; operators with timers and lists need it
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Python workers see batches of bounded size, however large single files or images are
    "spark.sql.execution.arrow.maxBytesPerBatch": "64MB",
    # records of Python's streaming state are blobs of some 100 KB; the default of 10,000 at a time would be GB
    "spark.sql.execution.arrow.transformWithStateInPySpark.maxStateRecordsPerBatch": "64",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else has built."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    context = spark.sparkContext
    if not context.master.startswith("local"):
        # start shuffles fine enough for the largest tables; AQE merges small partitions again
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(8 * context.defaultParallelism))
    return spark


def local_session(name: str, cores: int = 8) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    builder = builder.config("spark.sql.shuffle.partitions", str(cores))
    builder = builder.config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
