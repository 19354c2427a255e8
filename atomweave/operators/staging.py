"""Tables that end a lineage: written to the folder that all executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver see: ``spark.checkpoint.dir``.

    Only on one machine may the setting be missing; then a temporary folder is made and set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors see")
        path = "file://" + tempfile.mkdtemp(prefix="atomweave-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table and read it back: what follows is planned from there."""
    path = f"{shared_dir(df.sparkSession)}/engine/{name}-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
