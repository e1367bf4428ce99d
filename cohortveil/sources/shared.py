"""Results that later steps read more than once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset, one below the warehouse.

    A warehouse that is a folder of this machine only serves a local session: on
    a cluster the setting is required.
    """
    context = spark.sparkContext
    told = context.getConf().get("spark.checkpoint.dir")
    if told:
        return told
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if not context.master.startswith("local") and warehouse.startswith(("file:", "/")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{warehouse}/checkpoints"


def kept(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read again, cut off from its lineage."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
