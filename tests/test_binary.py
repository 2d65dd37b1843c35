"""Avro and Protobuf against bytes made by hand from their specifications; feeds."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import binary, feeds


def test_numbers_of_the_specification():
    # zigzag: 0 -1 1 -2 2 -64 64
    assert [binary._zigzag(n).hex() for n in (0, -1, 1, -2, 2, -64, 64)] == ["00", "01", "02", "03", "04", "7f", "8001"]
    for n in (0, 1, -1, 2**62, -(2**63), 2**63 - 1):
        assert binary._read_long(binary._zigzag(n), 0)[0] == n


def test_a_container_made_by_hand():
    schema = {"type": "record", "name": "t", "fields": [{"name": "a", "type": "long"}, {"name": "b", "type": ["null", "string"]}, {"name": "c", "type": "boolean"}, {"name": "d", "type": "float"}]}
    rows = b"\x36\x02\x06foo\x01" + struct.pack("<f", 1.5) + b"\x01\x00\x00" + struct.pack("<f", -2)
    text, sync = json.dumps(schema).encode(), bytes(range(16))
    data = b"Obj\x01" + b"\x02" + b"\x16avro.schema" + binary._zigzag(len(text)) + text + b"\x00" + sync + b"\x04" + binary._zigzag(len(rows)) + rows + sync
    assert list(binary.avro_rows(data)) == [{"a": 27, "b": "foo", "c": True, "d": 1.5}, {"a": -1, "b": None, "c": False, "d": -2.0}]
    for broken in (b"x" + data, data[:-3], data.replace(b"avro.schema", b"avro.schemb")):
        with pytest.raises((ValueError, KeyError)):
            list(binary.avro_rows(broken))


def test_a_message_made_by_hand():
    kinds, numbers = {"a": "int", "b": "string", "c": "double"}, {"a": 1, "b": 2, "c": 3}
    assert binary.proto_message({"a": 150, "b": "testing", "c": None}, numbers, kinds) == bytes.fromhex("089601120774657374696e67")
    unknown = bytes.fromhex("089601") + b"\x22\x03abc" + b"\x2d\x00\x00\x00\x00" + b"\x08\x05"
    assert binary.proto_row(unknown, numbers, kinds) == {"a": 5, "b": None, "c": None}
    assert binary.proto_row(binary.proto_message({"a": -1, "b": "", "c": -0.5}, numbers, kinds), numbers, kinds) == {"a": -1, "b": "", "c": -0.5}
    for broken in (b"\x08", b"\x12\x07te", b"\x0b", b"\x0a\x01x"):
        with pytest.raises(ValueError):
            binary.proto_row(broken, numbers, kinds)


def test_every_type_and_nulls(spark):
    rows = spark.sql("SELECT * FROM VALUES (true, 1, 2L, float(0.5), 0.25D, 'x', X'00ff'), (null, null, null, null, null, null, null) t(a, b, c, d, e, f, g)")
    assert binary.from_avro(binary.to_avro(rows), rows.schema).collect() == rows.collect()
    numbers = {c: i + 1 for i, c in enumerate(rows.columns)}
    ddl = "a boolean, b int, c long, d float, e double, f string, g binary"
    assert binary.from_proto(binary.to_proto(rows, numbers), ddl, numbers).collect() == rows.collect()
    assert binary.from_avro(binary.to_avro(rows.limit(0)), rows.schema).collect() == []


def test_a_feed_of_files(spark, tmp_path):
    rows = [("k1", '{"n": 1}', "a", 0, 0), ("k2", "no json", "a", 1, 0), (None, None, "b", 0, 1)]
    df = spark.createDataFrame(rows, "key string, value string, topic string, partition int, offset long").withColumn("timestamp", F.lit("2024-01-01").cast("timestamp"))
    df.coalesce(1).write.json(str(tmp_path / "in"))
    stream = feeds.parsed(feeds.feed(spark, "files", {"path": str(tmp_path / "in")}), "n long")
    routed = stream.withColumn("topic", feeds.routed_topic([(F.col("broken"), "dead")], "good")).select("key", "topic", "offset")
    for _ in range(2):  # the second run finds nothing new
        feeds.to_files(routed, str(tmp_path / "out"), str(tmp_path / "offsets"))
    assert sorted((r["topic"], r["offset"]) for r in spark.read.json(str(tmp_path / "out")).collect()) == [("dead", 0), ("dead", 1), ("good", 0)]
    with pytest.raises(ValueError):
        feeds.feed(spark, "carrier pigeon", {})
