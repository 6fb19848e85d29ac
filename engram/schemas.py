"""Explicit schemas of the input tables."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

TEXT, INT, LONG, TIME, FLAG = StringType(), IntegerType(), LongType(), TimestampType(), BooleanType()


def struct(**fields: DataType) -> StructType:
    return StructType([StructField(name, type_) for name, type_ in fields.items()])


MEMORY = struct(
    owner_id=TEXT,
    id=TEXT,
    content=TEXT,
    created_at=TIME,
    updated_at=TIME,
    memory_type=TEXT,
    state=TEXT,
    tags=ArrayType(TEXT),
    metadata_json=TEXT,
)
BATCH = struct(
    job_id=TEXT,
    batch_index=INT,
    memory_count=INT,
    payload_hash=TEXT,
    memories=ArrayType(struct(id=TEXT, content=TEXT, created_at=TEXT, metadata_json=TEXT)),
)
SNAPSHOT_DOCUMENT = struct(
    fetchedAt=TEXT,
    memoryCount=INT,
    memories=ArrayType(
        struct(id=TEXT, content=TEXT, createdAt=TEXT, updatedAt=TEXT, memoryType=TEXT, tags=ArrayType(TEXT))
    ),
)
RULE = struct(
    id=TEXT,
    version=TEXT,
    category=TEXT,
    label=TEXT,
    lang=TEXT,
    match_type=TEXT,
    pattern=TEXT,
    weight=INT,
    enabled=FLAG,
)
AUDIT = struct(
    request_id=TEXT,
    owner_id=TEXT,
    ts=TIME,
    route=TEXT,
    job_id=TEXT,
    batch_index=INT,
    memory_count=INT,
    status_code=INT,
    latency_ms=INT,
)

JOB_VERSION = struct(job_id=TEXT, version=LONG)
