"""Streams over stored tables, run to their end, with results that can be read as tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only where the session names none."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        where = tempfile.mkdtemp(prefix="sparkloom-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def read_stream(spark: SparkSession, sf_dir: str, table: str, files_per_trigger: int = 8) -> DataFrame:
    """A table as a stream of its files, whether it is one file or a folder of them."""
    path = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    is_folder = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path) if is_folder else reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def run(stream: DataFrame, mode: str, each: Callable[[DataFrame, int], None]) -> None:
    """Take all that is there now, batch by batch, with offsets and state in the shared folder."""
    place = f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", place)
    writer.trigger(availableNow=True).start().awaitTermination()


def complete(stream: DataFrame) -> DataFrame:
    """The final state of a streaming aggregation."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/result-{uuid.uuid4().hex}"
    run(stream, "complete", lambda df, n: df.write.mode("overwrite").parquet(f"{path}/{n}") or _last.__setitem__(path, n))
    return spark.read.schema(stream.schema).parquet(f"{path}/{_last[path]}") if path in _last else spark.createDataFrame([], stream.schema)


_last: dict[str, int] = {}


def appended(stream: DataFrame) -> DataFrame:
    """All rows that a stream without aggregation, or with a watermark, gives. A batch that is run again replaces
    its own folder, so each row is there once."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/result-{uuid.uuid4().hex}"
    numbers: list[int] = []

    def put(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/{n}")
        numbers.append(n)

    run(stream, "append", put)
    return spark.read.schema(stream.schema).parquet(*(f"{path}/{n}" for n in sorted(set(numbers)))) if numbers else spark.createDataFrame([], stream.schema)
