"""Reading tables that may not have been written yet."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_or_empty(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", **options: str
) -> DataFrame:
    """The table at `path` under a declared schema; no rows if it does not exist."""
    try:
        return spark.read.schema(schema).format(fmt).options(**options).load(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return empty(spark, schema)


def types_key(schema: T.StructType) -> str:
    """A short name of column names and types, for folders that hold files of one kind."""
    listed = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in schema.fields)
    return uuid.uuid5(uuid.NAMESPACE_URL, listed).hex[:12]


def subfolders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Names of the folders in `path` that begin with `prefix`."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()]
    return sorted(n for n in names if n.startswith(prefix))


def folder_bytes(spark: SparkSession, path: str) -> int:
    """The size of all files below `path`."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(folder).getLength() if fs.exists(folder) else 0


def recast(df: DataFrame, schema: T.StructType) -> DataFrame:
    """`df` under another schema: absent columns are null, and so are values that have no form in it."""
    have = {f.name: f.dataType for f in df.schema.fields}
    return df.select(
        *[
            (
                F.lit(None).cast(f.dataType)
                if f.name not in have
                else F.col(f.name)
                if have[f.name] == f.dataType
                else F.to_json(F.col(f.name))
                if isinstance(f.dataType, T.StringType) and isinstance(have[f.name], T.ArrayType)
                else F.from_json(F.col(f.name), f.dataType)
                if isinstance(f.dataType, T.ArrayType) and isinstance(have[f.name], T.StringType)
                else F.lit(None).cast(f.dataType)
                if isinstance(f.dataType, T.ArrayType) != isinstance(have[f.name], T.ArrayType)
                else F.col(f.name).try_cast(f.dataType)
            ).alias(f.name)
            for f in schema.fields
        ]
    )


def add_records(records: DataFrame, path: str) -> None:
    """Append to a small table of records. Every append has a folder of its own, because
    two jobs that append to one folder remove each other's unfinished files."""
    records.write.parquet(f"{path}/{uuid.uuid4().hex}")


def records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All records appended below `path`."""
    return read_or_empty(spark, path, schema, recursiveFileLookup="true")


def rows(spark: SparkSession, values: Sequence[tuple], schema: T.StructType) -> DataFrame:
    """A few driver-side rows, such as one run record, as a table."""
    return spark.createDataFrame(list(values), schema).coalesce(1)
