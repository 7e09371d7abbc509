"""Model storage: Parquet tables and one row of metadata in a folder that Spark can reach."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def save(path: str, kind: str, parameters: dict, tables: dict[str, DataFrame]) -> None:
    """Write a model; parameters that are None are left out.  An existing folder is an error."""
    if not tables:
        raise ValueError("the model is not fitted")
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
    known = {k: v for k, v in parameters.items() if v is not None}
    row = [(json.dumps({"kind": kind, "parameters": known, "tables": sorted(tables)}),)]
    spark.createDataFrame(row, "value string").coalesce(1).write.text(f"{path}/metadata")


def load(spark: SparkSession, path: str, kind: str | None = None) -> tuple[dict, dict[str, DataFrame]]:
    """Parameters and tables of a stored model."""
    said = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    if kind is not None and said["kind"] != kind:
        raise ValueError(f"{path} holds a model of kind {said['kind']}, not {kind}")
    return said["parameters"], {t: spark.read.parquet(f"{path}/{t}") for t in said["tables"]}
