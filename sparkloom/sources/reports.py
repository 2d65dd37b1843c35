"""Report exports and splits of inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.sources import files

EXPORTERS = {"csv": "csv", "json": "json", "xml": "xml", "parquet": "parquet"}


def export(sections: dict[str, DataFrame], path: str, format_: str) -> list[str]:
    """Write each section of a report into a folder of its own."""
    if format_ not in EXPORTERS:
        raise ValueError(f"unknown format {format_!r}")
    out = []
    for name, df in sections.items():
        files.write(df, f"{path}/{name}", EXPORTERS[format_], mode="overwrite")
        out.append(f"{path}/{name}")
    return out


def line_ranges(lines: int, parts: int) -> list[tuple[int, int]]:
    """Equal ranges [from, to) of lines, the rest to the last."""
    each = lines // parts
    return [(i * each, lines if i == parts - 1 else (i + 1) * each) for i in range(parts)]


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All lines of files, folders or globs, with the file they are from."""
    return spark.read.text(paths).selectExpr("value AS line", "input_file_name() AS file")


def follow(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of files as they appear in a folder; which files were read is kept in the stream's checkpoint."""
    return spark.readStream.text(folder).selectExpr("value AS line")
