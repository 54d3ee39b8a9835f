"""Session settings and lineage cuts shared by every operator."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def get_session(app_name: str = "straitline", **conf: str) -> SparkSession:
    """A session with the settings the operators rely on (UTC, adaptive execution).

    Master and sizes are left to spark-submit; pass ``conf`` for anything else.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _checkpoint_dir_ready(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get(CHECKPOINT_CONF, None) or context.getConf().get(CHECKPOINT_CONF)
    if shared:
        context.setCheckpointDir(shared)
        return
    if not context.master.startswith("local"):
        raise RuntimeError(
            f"set {CHECKPOINT_CONF} to a folder every executor can reach; "
            "iterative operators cut their lineage there"
        )
    context.setCheckpointDir(tempfile.mkdtemp(prefix="straitline-checkpoint-"))


def scratch_folder(spark: SparkSession) -> str:
    """A folder every executor can reach: the cluster's checkpoint folder."""
    _checkpoint_dir_ready(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so that lost executors never restart a loop."""
    _checkpoint_dir_ready(df.sparkSession)
    return df.checkpoint(eager=True)
