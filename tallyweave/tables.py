"""Access to the input tables and to the shared folder used for cut points."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; a lazily planned Parquet scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by spark.checkpoint.dir.

    Where the session does not name one a local run (tests) uses a temporary folder and sets it; on a
    cluster, whose machines could not read such a folder, that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        kept = spark.sparkContext.getCheckpointDir()
        if not kept and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = kept or "file://" + os.path.join(tempfile.gettempdir(), "tallyweave-" + uuid.uuid4().hex[:12])
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and returns the table read back, which cuts its lineage.

    Unlike a local checkpoint the files outlive any executor.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def cut_and_count(df: DataFrame) -> tuple[DataFrame, int]:
    """cut() with the number of rows written, which is observed while writing and needs no job of its own."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]


MOST_FIXED = 100_000


def few(df: DataFrame, most: int = MOST_FIXED) -> list:
    """The rows of a table that is fixed by its nature (zones, agreed names, capacities); more than ``most`` are an error, not a full driver."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a fixed table has more than {most} rows: {df.columns}")
    return rows
