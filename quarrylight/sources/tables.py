"""Parquet table loading.

Schemas come from the parquet footers, which is metadata only; readers of
text formats take explicit schemas (see ``sources.files``).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``directory`` (a file or a folder of parts)."""
    return spark.read.parquet(os.path.join(directory, f"{name}.parquet"))
