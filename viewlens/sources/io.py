"""Scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewlens import schemas as S


def table_path(base: str, name: str) -> str:
    return f"{base.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, base: str, name: str, columns=None) -> DataFrame:
    """Parquet scan; column pruning and filter pushdown are Catalyst's."""
    df = spark.read.parquet(table_path(base, name))
    return df.select(*columns) if columns else df


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jpath)


def require(spark: SparkSession, path: str, hint: str) -> None:
    """Stop before any work when an upstream output is missing."""
    if not exists(spark, path):
        raise FileNotFoundError(f"{path} not found. {hint}")


def read_optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read a table that may not exist yet; absent means empty."""
    if exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def read_keys(spark: SparkSession, path: str, key: str = "video_id",
              schema: T.StructType | None = None) -> DataFrame:
    """S5/S6/S8 + A28: distinct keys already stored (empty when absent)."""
    schema = schema or T.StructType([T.StructField(key, T.StringType())])
    return read_optional(spark, path, schema).select(key).distinct()


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """One row per export block, split on the block separator.

    The text source splits files by bytes, so one huge export is read by
    many tasks; inner newlines stay inside a block.
    """
    return spark.read.option("lineSep", S.BLOCK_SEPARATOR).text(path).withColumnRenamed("value", "block")


def write_blocks(df: DataFrame, path: str, column: str = "block") -> None:
    """Inverse of read_export: blocks joined by the separator (fixture/landing use)."""
    df.select(column).write.mode("overwrite").option("lineSep", S.BLOCK_SEPARATOR).text(path)


def overwrite(df: DataFrame, path: str, partition_by=None) -> None:
    """K1: atomic replace (one job commit), optionally partitioned."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def append(df: DataFrame, path: str) -> None:
    """K2-K5/U4: one commit per run; a failed run leaves no partial files."""
    df.write.mode("append").parquet(path)


def _csv_ready(df: DataFrame) -> DataFrame:
    """K6: arrays become '|'-joined text; everything else as is."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            out.append(F.array_join(F.col(f.name), "|").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


CSV_FILE_ROWS = 1_000_000


def write_csv(df: DataFrame, path: str) -> None:
    """CSV-compat sink: every field quoted, quotes doubled, header, multi-line
    safe; at most CSV_FILE_ROWS rows a file, as a file is read by one task."""
    (_csv_ready(df).write.mode("overwrite").option("maxRecordsPerFile", CSV_FILE_ROWS)
     .option("header", True).option("quoteAll", True).option("escape", '"')
     .option("emptyValue", "").csv(path))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, multiline: bool = True) -> DataFrame:
    """S2/S4 CSV import with an explicit schema; only empty fields are NULL.
    Array columns are read as '|'-joined text and split (empty: no entries).

    A quoted line break can only be told from a record's end by reading a
    file from its start, so a file is one task: the writer spreads a table
    over many files. ``multiline=False`` splits files that hold none."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    flat = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.ArrayType) else f.dataType)
                         for f in schema.fields])
    df = (spark.read.schema(flat).option("header", True).option("multiLine", multiline)
          .option("escape", '"').option("mode", "FAILFAST").csv(path))
    return df.select(*(
        F.when(F.col(f.name).isNull(), F.array().cast(f.dataType)).otherwise(F.split(f.name, r"\|").cast(f.dataType)).alias(f.name)
        if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in schema.fields))
