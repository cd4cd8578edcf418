"""Session settings the engine relies on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings: all may be changed on a running session.
RUNTIME_CONF = {
    # A repeated key in one object keeps its last value instead of voiding the record.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM never compiles methods beyond 8000 bytes. Wide normalisers would run
    # interpreted inside one fused method, so such stages use the unfused operators.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def spread(df: DataFrame) -> DataFrame:
    """Rebalance only an input with fewer partitions than cores, before costly parsing.

    Large inputs already have many splits and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


ROWS_PER_TASK = 100_000  # sizes tasks, drops nothing


def deal_rows(df: DataFrame) -> DataFrame:
    """Deal the rows of a narrow table evenly to tasks of bounded size, before costly parsing.

    Splits of a file say little: a row group is read by one task, so that a file of few
    large ones has empty splits and long tasks. Counting a Parquet table reads its footers.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // ROWS_PER_TASK)))


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session (idempotent)."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def new_session(app: str = "loomrecord", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session; cluster submitters normally pass their own and call configure()."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below the cluster's shared spark.checkpoint.dir.

    Only where that setting is absent (local tests) is a temporary folder chosen,
    and it is recorded in the session so that later calls share it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="loomrecord-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "stage", partition_by: list[str] | None = None) -> DataFrame:
    """Write a DataFrame to the shared scratch folder and read it back.

    Cuts lineage in a way that survives executor loss, and gives repeated readers
    a columnar copy instead of re-running JSON parsing.
    """
    spark = df.sparkSession
    target = f"{scratch_dir(spark)}/{name}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(target)
    return spark.read.schema(df.schema).parquet(target)
