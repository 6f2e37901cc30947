"""Encoded events and alerts: decode with malformed rows split off, and encode.

``json`` payloads use native functions. ``protobuf`` payloads use Spark's protobuf functions when their
package is on the class path, else a small Arrow-batched decoder. The message layout is built from the
Spark schema below.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ravelin.schema import ALERT_SCHEMA, EVENT_SCHEMA, EVENT_TYPES, SEVERITIES, normalise_events

# Field numbers of the encoded messages.
EVENT_NUMBERS = {
    "event_id": 1,
    "type": 2,
    "timestamp": 3,
    "hostname": 4,
    "source_ip": 5,
    "destination_ip": 6,
    "source_port": 7,
    "destination_port": 8,
    "user": 9,
    "process": 10,
    "service": 11,
    "raw_message": 12,
    "metadata": 13,
    "agent_id": 14,
    "severity": 15,
}
ALERT_NUMBERS = {
    "alert_id": 1,
    "rule_id": 2,
    "rule_name": 3,
    "severity": 4,
    "created_at": 5,
    "description": 6,
    "group_values": 7,
    "event_count": 8,
    "event_ids": 9,
    "tags": 10,
    "enrichment": 11,
}
MESSAGES = {"SecurityEvent": (EVENT_SCHEMA, EVENT_NUMBERS), "Alert": (ALERT_SCHEMA, ALERT_NUMBERS)}
ENUMS = {"type": ("EventType", EVENT_TYPES), "severity": ("Severity", SEVERITIES)}
PACKAGE = "ravelin"
CORRUPT = "_corrupt"
JSON_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


@dataclass(frozen=True)
class Decoded:
    good: DataFrame
    malformed: DataFrame


def descriptor_set() -> bytes:
    """The message layout for ``from_protobuf(..., binaryDescriptorSet=...)``."""
    from google.protobuf import descriptor_pb2, timestamp_pb2

    Field = descriptor_pb2.FieldDescriptorProto
    files = descriptor_pb2.FileDescriptorSet()
    stamp = files.file.add()
    timestamp_pb2.DESCRIPTOR.CopyToProto(stamp)
    file = files.file.add(name="events.proto", package=PACKAGE, syntax="proto3", dependency=[stamp.name])
    for enum_name, values in ENUMS.values():
        enum = file.enum_type.add(name=enum_name)
        for number, value in enumerate(values):
            enum.value.add(name=value, number=number)
    for message_name, (schema, numbers) in MESSAGES.items():
        message = file.message_type.add(name=message_name)
        for column in schema:
            spec = message.field.add(name=column.name, number=numbers[column.name], label=Field.LABEL_OPTIONAL)
            if column.name in ENUMS:
                spec.type, spec.type_name = Field.TYPE_ENUM, f".{PACKAGE}.{ENUMS[column.name][0]}"
            elif isinstance(column.dataType, T.TimestampType):
                spec.type, spec.type_name = Field.TYPE_MESSAGE, ".google.protobuf.Timestamp"
            elif isinstance(column.dataType, T.LongType):
                spec.type = Field.TYPE_UINT32
            elif isinstance(column.dataType, T.MapType):
                entry_name = "".join(part.title() for part in column.name.split("_")) + "Entry"
                entry = message.nested_type.add(name=entry_name)
                entry.options.map_entry = True
                entry.field.add(name="key", number=1, label=Field.LABEL_OPTIONAL, type=Field.TYPE_STRING)
                entry.field.add(name="value", number=2, label=Field.LABEL_OPTIONAL, type=Field.TYPE_STRING)
                spec.type, spec.label = Field.TYPE_MESSAGE, Field.LABEL_REPEATED
                spec.type_name = f".{PACKAGE}.{message_name}.{entry_name}"
            else:
                spec.type = Field.TYPE_STRING
                if isinstance(column.dataType, T.ArrayType):
                    spec.label = Field.LABEL_REPEATED
    return files.SerializeToString()


def message_class(descriptors: bytes, name: str):
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    pool = descriptor_pool.DescriptorPool()
    for file in descriptor_pb2.FileDescriptorSet.FromString(descriptors).file:
        pool.Add(file)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName(f"{PACKAGE}.{name}"))


def _enum_text(values: list[str], number: int) -> str:
    """A number outside the list prints as a decimal."""
    return values[number] if 0 <= number < len(values) else str(number)


def _parsed(make, data: bytes | None):
    message = make()
    try:
        message.ParseFromString(data)
    except Exception:  # noqa: BLE001 - any parse failure marks the row as malformed
        return None
    return message


def _decode_python(df: DataFrame, payload: str, name: str) -> DataFrame:
    schema, descriptors, enums = MESSAGES[name][0], descriptor_set(), ENUMS
    kept = [f for f in df.schema.fields if f.name != payload]
    shape = T.StructType([*kept, T.StructField(payload, T.BinaryType()), T.StructField("decoded", schema)])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = message_class(descriptors, name)

        def column(field, messages):
            told = field.name
            if told in enums:
                values = enums[told][1]
                return [None if m is None else _enum_text(values, getattr(m, told)) for m in messages]
            if isinstance(field.dataType, T.TimestampType):
                return [None if m is None or not m.HasField(told) else getattr(m, told).ToNanoseconds() // 1000 for m in messages]
            if isinstance(field.dataType, T.MapType):
                return [None if m is None else list(getattr(m, told).items()) for m in messages]
            if isinstance(field.dataType, T.ArrayType):
                return [None if m is None else list(getattr(m, told)) for m in messages]
            return [None if m is None else getattr(m, told) for m in messages]

        for batch in batches:
            messages = [_parsed(make, data) for data in batch.column(payload).to_pylist()]
            arrays = [pa.array(column(field, messages), kind.type) for field, kind in zip(schema, kinds)]
            broken = pa.array([m is None for m in messages], pa.bool_())
            decoded = pa.StructArray.from_arrays(arrays, fields=list(kinds), mask=broken)
            columns = [*(batch.column(f.name) for f in kept), batch.column(payload), decoded]
            yield pa.RecordBatch.from_arrays(columns, shape.names)

    return df.select(*[f.name for f in kept], F.col(payload).cast("binary").alias(payload)).mapInArrow(run, shape)


def _malformed_python(df: DataFrame, payload: str, name: str) -> DataFrame:
    """The rows that do not parse; no field of the others is read."""
    descriptors = descriptor_set()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = message_class(descriptors, name)
        for batch in batches:
            yield batch.filter(pa.array([_parsed(make, data) is None for data in batch.column(payload).to_pylist()], pa.bool_()))

    rows = df.withColumn(payload, F.col(payload).cast("binary"))
    return rows.mapInArrow(run, rows.schema)


def has_protobuf_package(df: DataFrame) -> bool:
    from pyspark.sql.protobuf.functions import from_protobuf

    try:
        df.limit(0).select(
            from_protobuf(F.lit(b"").cast("binary"), f"{PACKAGE}.SecurityEvent", binaryDescriptorSet=descriptor_set())
        )
        return True
    except Exception:  # noqa: BLE001 - the class is missing or the package is another version
        return False


def decode(df: DataFrame, payload: str = "value", message: str = "SecurityEvent", encoding: str = "json") -> Decoded:
    """Decoded rows next to the malformed ones. Other columns of ``df`` go along. Events come out in canonical form,
    so one that leaves out its id has an empty one and is ingest's to reject."""
    schema, malformed = MESSAGES[message][0], None
    if encoding == "json":
        wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, **JSON_TIMES}
        parsed = F.from_json(F.col(payload).cast("string"), wide, options)
        sound = F.filter(F.array(parsed), lambda d: d[schema.names[0]].isNotNull() | (d.isNotNull() & d[CORRUPT].isNull()))
        rows = df.withColumn("decoded", F.get(F.transform(sound, lambda d: d.dropFields(CORRUPT)), 0))
    elif has_protobuf_package(df):
        from pyspark.sql.protobuf.functions import from_protobuf

        rows = df.withColumn(
            "decoded",
            from_protobuf(
                F.col(payload),
                f"{PACKAGE}.{message}",
                options={"mode": "PERMISSIVE", "emit.default.values": "true"},
                binaryDescriptorSet=descriptor_set(),
            ),
        )
    else:
        rows, malformed = _decode_python(df, payload, message), _malformed_python(df, payload, message)
    others = [c for c in df.columns if c != payload]
    # The generator keeps the optimizer from decoding once per column.
    good = rows.select(*others, F.inline(F.filter(F.array("decoded"), lambda d: d.isNotNull())))
    if message == "SecurityEvent":
        good = normalise_events(good)
    bad = rows.filter("decoded IS NULL") if malformed is None else malformed
    return Decoded(good, bad.select(*others, payload))


def encode_json(df: DataFrame, schema: T.StructType = EVENT_SCHEMA, name: str = "value") -> DataFrame:
    return df.withColumn(name, F.to_json(F.struct(*schema.names), JSON_TIMES))


def encode_protobuf(df: DataFrame, message: str = "SecurityEvent", name: str = "value") -> DataFrame:
    """Adds the encoded message as a binary column. An enum text outside the list may be its number; other text has
    no encoding, and its row gets a null."""
    schema, descriptors, enums = MESSAGES[message][0], descriptor_set(), ENUMS
    shape = T.StructType([*df.schema.fields, T.StructField(name, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = message_class(descriptors, message)

        def put(column):
            """What sets a value that is there; false says that it has no encoding and its row is split off when read."""
            told = column.name
            if told in enums:
                names = {text: number for number, text in reversed(list(enumerate(enums[told][1])))}

                def enum(out, value):
                    if value not in names and not value.lstrip("-").isdigit():
                        return False
                    setattr(out, told, names[value] if value in names else int(value))

                return enum
            if isinstance(column.dataType, T.TimestampType):
                return lambda out, value: getattr(out, told).FromNanoseconds(value * 1000)
            if isinstance(column.dataType, T.MapType):
                return lambda out, value: getattr(out, told).update(dict(value))
            if isinstance(column.dataType, T.ArrayType):
                return lambda out, value: getattr(out, told).extend(value)
            return lambda out, value: setattr(out, told, value)

        setters = [put(column) for column in schema]

        def one(values) -> bytes | None:
            out = make()
            for setter, value in zip(setters, values):
                if value is not None and setter(out, value) is False:
                    return None
            return out.SerializeToString(deterministic=True)

        def plain(column, array):
            return (array.cast(pa.int64()) if isinstance(column.dataType, T.TimestampType) else array).to_pylist()

        for batch in batches:
            rows = zip(*[plain(column, batch.column(column.name)) for column in schema])
            encoded = pa.array([one(values) for values in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in shape.fields[:-1]), encoded], shape.names)

    return df.mapInArrow(run, shape)
