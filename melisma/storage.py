"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def saved(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """The table written as Parquet and read back: later steps share the work, and the
    rows outlive any executor.

    Without ``folder`` it lies in ``spark.checkpoint.dir``; only where that is absent
    in a local session a temporary folder is set, on a cluster its absence is an error.
    """
    spark = df.sparkSession
    if folder is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            shared = "file://" + tempfile.mkdtemp(prefix="melisma-")
            spark.conf.set("spark.checkpoint.dir", shared)
        folder = f"{shared.rstrip('/')}/stage-{uuid.uuid4().hex}"
    path = f"{folder.rstrip('/')}/{name}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def save_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Tables by name, each as Parquet beside the others, to go on from another day."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}.parquet")


def load_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet") for name in names}
