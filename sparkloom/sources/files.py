"""Readers and writers of log stores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "json", "csv", "xml", "text")


def write(df: DataFrame, path: str, format_: str, mode: str = "errorifexists", partition_by: Sequence[str] = (), rows_per_file: int = 0, **options: str) -> None:
    """Write in one of FORMATS; CSV gets a header, XML a row tag. rows_per_file rotates files."""
    defaults = {"csv": {"header": "true"}, "xml": {"rowTag": "row", "rootTag": "rows"}}.get(format_, {})
    if rows_per_file:
        defaults["maxRecordsPerFile"] = str(rows_per_file)
    df.write.format(format_).mode(mode).partitionBy(*partition_by).options(**defaults | options).save(path)


def read(spark: SparkSession, path: str | list[str], format_: str, schema: str | None = None, **options: str) -> DataFrame:
    defaults = {"csv": {"header": "true"}, "xml": {"rowTag": "row"}, "json": {"mode": "PERMISSIVE"}}.get(format_, {})
    reader = spark.read.format(format_).options(**defaults | options)
    return (reader.schema(schema) if schema else reader).load(path)


def read_mixed(spark: SparkSession, parts: Sequence[tuple[str, str]], columns: Sequence[str]) -> DataFrame:
    """Rows of parts (path, format) in different formats; a column that a part lacks is null there."""
    out = None
    for path, format_ in parts:
        df = read(spark, path, format_)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.select(*(F.col(c) if c in out.columns else F.lit(None).alias(c) for c in columns))


def seal(df: DataFrame, ts: str, cutoff: object) -> tuple[DataFrame, DataFrame]:
    """(sealed, recent): rows before the cutoff, and the others with those without a time."""
    old = F.coalesce(F.col(ts) < F.lit(cutoff), F.lit(False))
    return df.where(old), df.where(~old)


def migrate(spark: SparkSession, source: str, source_format: str, target: str, target_format: str, schema: str | None = None) -> DataFrame:
    """Copy a store into another format; the source stays. Returns the new store."""
    rows = read(spark, source, source_format, schema)
    write(rows, target, target_format)
    return read(spark, target, target_format, schema or (rows._jdf.schema().toDDL() if target_format in ("csv", "json", "xml") else None))


def choose_format(reads_all_columns: float, appends_share: float) -> str:
    """Row files for stores that are mostly appended to or read whole, columnar ones for narrow scans, else both."""
    if appends_share > 0.7 and reads_all_columns > 0.5:
        return "json"
    return "parquet" if appends_share < 0.3 or reads_all_columns < 0.2 else "hybrid"
