"""Message feeds by name of a format: Kafka where its connector is installed, folders of JSON lines anywhere, both with the same columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a feed's rows have, whatever it comes from.
SCHEMA = "key string, value string, topic string, partition int, offset long, timestamp timestamp"
_OPENERS: dict[str, Callable[[SparkSession, Mapping[str, str]], DataFrame]] = {}


def opener(name: str) -> Callable:
    """Register how a feed of a format is opened."""

    def add(f: Callable) -> Callable:
        _OPENERS[name] = f
        return f

    return add


@opener("kafka")
def _kafka(spark: SparkSession, options: Mapping[str, str]) -> DataFrame:
    """Needs the connector's jar; offsets are kept in the query's checkpoint, which gives each record to a sink that is idempotent once."""
    rows = spark.readStream.format("kafka").options(**options).load()
    return rows.select(F.col("key").cast("string"), F.col("value").cast("string"), "topic", "partition", "offset", "timestamp")


@opener("files")
def _files(spark: SparkSession, options: Mapping[str, str]) -> DataFrame:
    """A folder of JSON lines with these columns; new files are new messages. options: path, and maxFilesPerTrigger."""
    rest = {k: v for k, v in options.items() if k != "path"}
    return spark.readStream.schema(SCHEMA).options(**rest).json(options["path"])


def feed(spark: SparkSession, format_: str, options: Mapping[str, str]) -> DataFrame:
    """A stream of SCHEMA; a format that isn't registered is a ValueError."""
    if format_ not in _OPENERS:
        raise ValueError(f"no feed of format {format_}; there are {', '.join(sorted(_OPENERS))}")
    return _OPENERS[format_](spark, options)


def parsed(rows: DataFrame, schema: str) -> DataFrame:
    """A feed's rows with `body`, the value read as JSON of a schema, and `broken`, whether it is none."""
    body = F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    return rows.withColumn("body", body).withColumn("broken", F.col("value").isNull() | F.col("body").isNull() | F.col("body._bad").isNotNull())


def routed_topic(rules: list[tuple[Column, str]], default: str) -> Column:
    """The topic of the first rule that holds."""
    out = F.lit(default)
    for holds, topic in reversed(rules):
        out = F.when(holds, F.lit(topic)).otherwise(out)
    return out


def lag(high: DataFrame, committed: DataFrame) -> DataFrame:
    """(topic, partition, lag) of high(topic, partition, offset) watermarks and committed(topic, partition, offset) positions: never
    below 0; a partition without a committed position lags by all it has."""
    mine = committed.select("topic", "partition", F.col("offset").alias("_at"))
    return high.join(mine, ["topic", "partition"], "left").select("topic", "partition", F.greatest(F.col("offset") - F.coalesce("_at", F.lit(0)), F.lit(0)).alias("lag"))


def to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write a feed's rows as JSON lines by topic, batch by batch; a batch that is run again replaces its own folder, so each record
    is there once."""

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").partitionBy("topic").json(f"{path}/batch={n}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
