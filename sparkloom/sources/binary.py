"""Avro containers and Protobuf messages as binary columns, in Arrow batches, without jars. Schemas are flat: each field is a Spark
column of type boolean, int, long, float, double, string or binary, and may be null."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of one Avro container that to_avro() makes.
CONTAINER_ROWS = 10_000
# Fixed values of the formats: Avro's magic bytes and type names, Protobuf's wire types.
MAGIC = b"Obj\x01"
AVRO_TYPES = {"boolean": "boolean", "int": "int", "bigint": "long", "float": "float", "double": "double", "string": "string", "binary": "bytes"}
VARINT, FIXED64, LENGTH, FIXED32 = 0, 1, 2, 5


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("a number is cut off or too long")
        b = data[at]
        n, shift, at = n | (b & 127) << shift, shift + 7, at + 1
        if b < 128:
            return n, at


def _zigzag(n: int) -> bytes:
    return _varint(n << 1 ^ n >> 63)


def _read_long(data: bytes, at: int) -> tuple[int, int]:
    n, at = _read_varint(data, at)
    return n >> 1 ^ -(n & 1), at


def _bytes(data: bytes) -> bytes:
    return _zigzag(len(data)) + data


def _read_bytes(data: bytes, at: int) -> tuple[bytes, int]:
    n, at = _read_long(data, at)
    if n < 0 or at + n > len(data):
        raise ValueError("a value is cut off")
    return data[at : at + n], at + n


_WRITE: dict[str, Callable] = {
    "boolean": lambda v: b"\x01" if v else b"\x00", "int": _zigzag, "long": _zigzag, "float": lambda v: struct.pack("<f", v),
    "double": lambda v: struct.pack("<d", v), "string": lambda v: _bytes(v.encode()), "bytes": _bytes,
}


def _read_value(kind: str, data: bytes, at: int) -> tuple[object, int]:
    if kind == "null":
        return None, at
    if kind in ("int", "long"):
        return _read_long(data, at)
    if kind in ("string", "bytes"):
        raw, at = _read_bytes(data, at)
        return raw.decode() if kind == "string" else raw, at
    if kind == "boolean":
        return data[at] == 1, at + 1
    if kind in ("float", "double"):
        size = 4 if kind == "float" else 8
        return struct.unpack_from("<f" if size == 4 else "<d", data, at)[0], at + size
    raise ValueError(f"Avro type {kind} isn't flat")


def avro_schema(schema: StructType, name: str = "row") -> str:
    """The Avro schema of a flat Spark schema; every field may be null."""
    return json.dumps({"type": "record", "name": name, "fields": [{"name": f.name, "type": ["null", AVRO_TYPES[f.dataType.simpleString()]], "default": None} for f in schema]})


def avro_container(rows: list[dict], schema: str, deflate: bool = True) -> bytes:
    """Rows as one Avro object container with one block."""
    fields = [(f["name"], f["type"][1]) for f in json.loads(schema)["fields"]]
    body = b"".join(b"\x00" if r[name] is None else b"\x02" + _WRITE[kind](r[name]) for r in rows for name, kind in fields)
    if deflate:
        squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = squeeze.compress(body) + squeeze.flush()
    meta = {"avro.schema": schema.encode(), "avro.codec": b"deflate" if deflate else b"null"}
    sync = zlib.crc32(body).to_bytes(4, "little") * 4  # any 16 bytes do
    head = MAGIC + _zigzag(len(meta)) + b"".join(_bytes(k.encode()) + _bytes(v) for k, v in meta.items()) + b"\x00" + sync
    return head + (_zigzag(len(rows)) + _bytes(body) + sync if rows else b"")


def avro_rows(data: bytes) -> Iterator[dict]:
    """The records of an Avro object container with a flat schema, by the writer's schema that it holds."""
    if data[:4] != MAGIC:
        raise ValueError("no Avro container")
    meta, at = {}, 4
    while True:
        n, at = _read_long(data, at)
        if n == 0:
            break
        if n < 0:  # a block of the map with its size in bytes
            _, at = _read_long(data, at)
        for _ in range(abs(n)):
            key, at = _read_bytes(data, at)
            meta[key.decode()], at = _read_bytes(data, at)
    sync, at = data[at : at + 16], at + 16
    codec = meta.get("avro.codec", b"null")
    if codec not in (b"null", b"deflate"):
        raise ValueError(f"codec {codec.decode()} isn't known")
    fields = [(f["name"], f["type"] if isinstance(f["type"], list) else [f["type"]]) for f in json.loads(meta["avro.schema"])["fields"]]
    while at < len(data):
        n, at = _read_long(data, at)
        body, at = _read_bytes(data, at)
        if data[at : at + 16] != sync:
            raise ValueError("a block doesn't end with the container's mark")
        at += 16
        if codec == b"deflate":
            body = zlib.decompress(body, -15)
        here = 0
        for _ in range(n):
            row = {}
            for name, kinds in fields:
                choice = 0
                if len(kinds) > 1:
                    choice, here = _read_long(body, here)
                row[name], here = _read_value(kinds[choice], body, here)
            yield row


def proto_message(row: dict, numbers: dict[str, int], kinds: dict[str, str]) -> bytes:
    """A row as a Protobuf message: int, long and boolean as varints, double and float as fixed numbers, text and bytes with
    their length; nulls are left out."""
    out = bytearray()
    for name, number in numbers.items():
        v, kind = row[name], kinds[name]
        if v is None:
            continue
        if kind in ("int", "bigint", "boolean"):
            out += _varint(number << 3 | VARINT) + _varint(int(v))
        elif kind in ("double", "float"):
            out += _varint(number << 3 | (FIXED64 if kind == "double" else FIXED32)) + struct.pack("<d" if kind == "double" else "<f", v)
        else:
            raw = v.encode() if kind == "string" else v
            out += _varint(number << 3 | LENGTH) + _varint(len(raw)) + raw
    return bytes(out)


def proto_row(data: bytes, numbers: dict[str, int], kinds: dict[str, str]) -> dict:
    """The inverse: fields that aren't known are skipped, those that are missing are null, of repeated ones the last counts."""
    names, row, at = {n: name for name, n in numbers.items()}, dict.fromkeys(numbers), 0
    while at < len(data):
        tag, at = _read_varint(data, at)
        wire = tag & 7
        if wire == VARINT:
            raw, at = _read_varint(data, at)
        elif wire == LENGTH:
            n, at = _read_varint(data, at)
            raw, at = data[at : at + n], at + n
        elif wire in (FIXED64, FIXED32):
            n = 8 if wire == FIXED64 else 4
            raw, at = data[at : at + n], at + n
        else:
            raise ValueError(f"wire type {wire} isn't known")
        if at > len(data):
            raise ValueError("a field is cut off")
        if (name := names.get(tag >> 3)) is not None:
            kind = kinds[name]
            fits = {"int": VARINT, "bigint": VARINT, "boolean": VARINT, "double": FIXED64, "float": FIXED32}.get(kind, LENGTH)
            if wire != fits:
                raise ValueError(f"field {name} has wire type {wire}")
            if fits == VARINT:
                row[name] = bool(raw) if kind == "boolean" else raw - (1 << 64) if raw >> 63 else raw
            elif fits == LENGTH:
                row[name] = raw.decode() if kind == "string" else raw
            else:
                row[name] = struct.unpack("<d" if kind == "double" else "<f", raw)[0]
    return row


def _mapped(df: DataFrame, fn: Callable[[list[dict]], Iterator[list[dict]]], schema: str | StructType) -> DataFrame:
    target = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    arrow = to_arrow_schema(target)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for rows in fn(b.to_pylist()):
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return df.mapInArrow(run, target)


def to_avro(df: DataFrame) -> DataFrame:
    """(content, n): df as Avro containers of at most CONTAINER_ROWS rows, one after another in each task. Spark has no sink for
    whole binary files, so they are values of a column; an external file's bytes are read as such by format binaryFile."""
    schema = avro_schema(df.schema)

    def pack(rows: list[dict]) -> Iterator[list[dict]]:
        for i in range(0, len(rows), CONTAINER_ROWS):
            part = rows[i : i + CONTAINER_ROWS]
            yield [{"content": avro_container(part, schema), "n": len(part)}]

    return _mapped(df, pack, "content binary, n int")


def from_avro(files: DataFrame, schema: str | StructType) -> DataFrame:
    """The records of the containers in column `content`, read as `schema`: fields that the writer didn't have are null, others
    are skipped. Null contents have no rows."""

    def unpack(rows: list[dict]) -> Iterator[list[dict]]:
        for r in rows:
            if r["content"] is not None:
                yield list(avro_rows(r["content"]))

    target = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    names = target.fieldNames()

    def fitted(rows: list[dict]) -> Iterator[list[dict]]:
        for part in unpack(rows):
            yield [{n: x.get(n) for n in names} for x in part]

    return _mapped(files.select("content"), fitted, target)


def to_proto(df: DataFrame, numbers: dict[str, int]) -> DataFrame:
    """(message): each row as a Protobuf message with these field numbers."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return _mapped(df.select(*numbers), lambda rows: iter([[{"message": proto_message(r, numbers, kinds)} for r in rows]]), "message binary")


def from_proto(messages: DataFrame, schema: str, numbers: dict[str, int], column: str = "message") -> DataFrame:
    """The rows of Protobuf messages."""
    kinds = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(schema)}
    return _mapped(messages.select(messages[column].alias("m")), lambda rows: iter([[proto_row(r["m"] or b"", numbers, kinds) for r in rows]]), schema)
