"""Small driver-side tables as local relations."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def local_frame(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Fitted parameters and the like as a DataFrame that needs no job to read."""
    struct = StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)
    columns = [pa.array([r[i] for r in rows], type=field.type) for i, field in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), schema=struct)
