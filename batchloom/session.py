"""Session helpers: recommended settings and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

# Settings the engine is tuned with. They are defaults for sessions this package starts; a session
# that already exists is used as it is.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The last of repeated JSON keys counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def get_session(app_name: str = "batchloom", **conf: str) -> SparkSession:
    """Get or start a session with the recommended settings plus ``conf``."""
    builder = SparkSession.builder.appName(app_name)
    for name, value in {**RECOMMENDED, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    A session without one keeps its stages beside its tables, in the warehouse folder, which Spark
    shares in the same way.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/batchloom-stages"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder; nothing is created yet."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table survives the loss of executors, cuts the lineage and fixes the values of
    anything that depends on the partitioning (ids numbered at ingest).
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
