"""Session, table and checkpoint helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "8", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tabulon")
        .config("spark.sql.shuffle.partitions", str(max(8, int(cores) if cores.isdigit() else 8)))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")  # checkpoints go when nothing refers to them
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table; columns are pruned and filters pushed by the caller's plan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only in local mode (tests), where that is unset, a folder of our own, for on a cluster executors would not share it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tabulon-ckpt-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; never a local one, for executors may be lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def code(c: Column | str) -> Column:
    """Form for code compare: blanks and tabs at both ends removed, capitals; blank becomes null."""
    c = F.col(c) if isinstance(c, str) else c
    x = F.upper(F.regexp_replace(c, r"^[ \t]+|[ \t]+$", ""))
    return F.when(x != "", x)


def narrow(df: DataFrame, max_rows: int, what: str) -> DataFrame:
    """Broadcast ``df`` only after counting that it has at most ``max_rows`` rows; else leave the join to Spark."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df
