"""Settings the library is meant to run with."""

from __future__ import annotations

from pyspark.sql import SparkSession

RECOMMENDED = {
    # Log times are UTC; all day and hour logic is too.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM does not compile methods above 8000 bytes of bytecode.  Wide
    # projections run faster as several small methods than as one that is
    # interpreted.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Python state functions get their rows in batches of this size.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
}


def configure(builder: SparkSession.Builder, shuffle_partitions: int | None = None) -> SparkSession.Builder:
    """Recommended settings; on a cluster leave the partition count to the engine's
    configuration (a few per core) and let adaptive execution merge small ones."""
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    return builder if shuffle_partitions is None else builder.config("spark.sql.shuffle.partitions", shuffle_partitions)


def require_utc(spark: SparkSession) -> SparkSession:
    """Sets the session time zone to UTC if it is another one."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark
