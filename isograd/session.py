"""Session settings the library relies on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings that change results: UTC, and adaptive execution for skew handling."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where it names none, as in tests, one folder per application is used inside the warehouse folder,
    which driver and executors share.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch/{spark.sparkContext.applicationId}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
