"""Session settings and the places where intermediate tables may live."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only after its size, rows times columns, was checked against this bound.
BROADCAST_CELLS = 1_000_000


def build_session(app: str = "emberfield", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the library assumes (UTC, AQE, skew handling)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    A cluster names its shared folder in ``spark.checkpoint.dir``. A throw-away folder is
    made only where nothing is set and Spark runs inside this one machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="emberfield-checkpoint-")
    sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder; it survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_cells: int = BROADCAST_CELLS) -> DataFrame:
    """Hint a broadcast when ``df`` holds at most ``max_cells`` values, else let Spark choose.

    Beyond the bound Spark sorts or hashes both sides, and adaptive execution splits hot keys.
    """
    max_rows = max_cells // max(1, len(df.columns))
    small = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if small else df
