"""Cutting lineage in the folder that all machines of a cluster share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` to ``spark.checkpoint.dir`` and read it back; a lost executor then costs no recomputation.

    The folder comes from the session.  Where none is set, a session on one machine, as in tests, gets a temporary one; a
    cluster without a shared folder is an error, as executors would not find each other's files.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp())
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
