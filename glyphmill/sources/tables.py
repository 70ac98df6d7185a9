"""Corpus and fact-table readers."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_corpus(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """Documents ``(doc_id, text, ...)``, optionally only the first ``n`` by id.

    The head slice is a bounded top-n per partition, not a global sort.
    """
    docs = spark.read.parquet(path)
    return docs if n is None else docs.orderBy("doc_id").limit(n)


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few rows known to the driver, as a local relation.

    Arrow input keeps them in the plan with their exact size, so the optimizer
    broadcasts them by itself and no task reads them.
    """
    fields = to_arrow_schema(StructType.fromDDL(schema))
    columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=fields))
