"""Binary event traces as a Spark data source, read and written.

Fixed values of the format, little-endian: a header of 40 bytes (magic, enters, exits, ticks, first
tick as 64-bit numbers after a 32-bit magic, then the timer's microseconds as a 32-bit number),
and records that begin with a tag byte.
"""

from __future__ import annotations

import itertools
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

HEADER = struct.Struct("<IQQQQI")
HEADER_BYTES, MAGIC = HEADER.size, 0xABADCAFE
TAG_ENTER, TAG_EXIT, TAG_TICK, TAG_ENTER_SITE = 0x0, 0x1, 0x4, 0x5
RECORD_BYTES = {TAG_ENTER: 5, TAG_EXIT: 1, TAG_TICK: 1, TAG_ENTER_SITE: 7}
SCHEMA = "trace_id string, tid long, seq long, kind string, routine_id long, call_site long, ts timestamp, tick long"
#: Bytes read at a time; a record that a chunk's end cuts is carried over.
CHUNK = 1 << 22


class BadTrace(ValueError):
    """The file is not a trace, ends within a record, or has a record of a kind that can't be read."""


def parse_header(raw: bytes) -> dict[str, int]:
    if len(raw) < HEADER.size:
        raise BadTrace("the header is cut short")
    magic, enters, exits, ticks, first, timer = HEADER.unpack(raw[: HEADER.size])
    if magic != MAGIC:
        raise BadTrace(f"bad magic {magic:#x}")
    return {"enters": enters, "exits": exits, "ticks": ticks, "first_tick": first, "timer_us": timer}


def decode(chunks: Iterator[bytes], trace_id: str, tid: int, first_tick: int = 0) -> Iterator[tuple]:
    """Rows of SCHEMA of the records in `chunks`; seq is the record's number, tick the ticks before it."""
    left, seq, tick = b"", 0, first_tick
    for chunk in chunks:
        data, at = left + chunk, 0
        while at < len(data):
            tag = data[at]
            size = RECORD_BYTES.get(tag)
            if size is None:
                raise BadTrace(f"illegal tag {tag:#x} at record {seq}")
            if at + size > len(data):
                break
            if tag == TAG_ENTER_SITE:
                row = ("ENTER", *struct.unpack_from("<IH", data, at + 1))
            elif tag == TAG_ENTER:
                row = ("ENTER", struct.unpack_from("<I", data, at + 1)[0], 0)
            else:
                row = ("EXIT" if tag == TAG_EXIT else "TICK", None, None)
            yield (trace_id, tid, seq, *row, None, tick)
            tick += tag == TAG_TICK
            seq += 1
            at += size
        left = data[at:]
    if left:
        raise BadTrace("the last record is cut short")


def encode(rows: Iterator, timer_us: int = 0, first_tick: int = 0) -> bytes:
    """A trace of rows with kind, routine_id and call_site, in order."""
    out, counts = [], {"ENTER": 0, "EXIT": 0, "TICK": 0}
    for row in rows:
        kind = row["kind"]
        counts[kind] += 1
        if kind == "ENTER":
            site = int(row["call_site"] or 0) & 0xFFFF
            routine = int(row["routine_id"])
            out.append(struct.pack("<BIH", TAG_ENTER_SITE, routine, site) if site else struct.pack("<BI", TAG_ENTER, routine))
        else:
            out.append(bytes([TAG_EXIT if kind == "EXIT" else TAG_TICK]))
    return HEADER.pack(MAGIC, counts["ENTER"], counts["EXIT"], counts["TICK"], first_tick, timer_us) + b"".join(out)


class _File(InputPartition):
    def __init__(self, path: str, tid: int):
        self.path, self.tid = path, tid


class TraceSource(DataSource):
    """Format `calltrace`: a file or folder of traces, one per thread; records can't be split, so a file is a task."""

    @classmethod
    def name(cls) -> str:
        return "calltrace"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return TraceReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return TraceWriter(self.options, overwrite)


class TraceReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        names = sorted(os.path.join(self.path, n) for n in os.listdir(self.path) if n.endswith(".trace")) if os.path.isdir(self.path) else [self.path]
        return [_File(n, i) for i, n in enumerate(names)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            header = parse_header(f.read(HEADER.size))
            yield from decode(iter(lambda: f.read(CHUNK), b""), os.path.basename(partition.path), partition.tid, header["first_tick"])


class TraceWriter(DataSourceWriter):
    """A task writes a file for each thread it meets; put a thread's rows in one task, in order, first."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.timer = options["path"], int(options.get("timer_us", 0))
        os.makedirs(self.path, exist_ok=True)
        if overwrite:
            for n in os.listdir(self.path):
                if n.endswith(".trace"):
                    os.unlink(os.path.join(self.path, n))

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        for tid, rows in itertools.groupby(iterator, key=lambda r: r["tid"]):
            name = os.path.join(self.path, f"{tid}-{uuid.uuid4().hex[:8]}")
            with open(f"{name}.part", "wb") as f:
                f.write(encode(rows, self.timer))
            os.rename(f"{name}.part", f"{name}.trace")
        return WriterCommitMessage()


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Traces on a file system that executors see as a local path."""
    spark.dataSource.register(TraceSource)
    return spark.read.format("calltrace").load(path)


def read_traces_any(spark: SparkSession, path: str) -> DataFrame:
    """Traces of any file system that Spark reads: whole files, decoded where they are read."""
    kind = T._parse_datatype_string(SCHEMA)

    def run(batches):
        arrow = to_arrow_schema(kind)
        for batch in batches:
            for row in batch.to_pylist():
                header = parse_header(row["content"])
                found = list(decode(iter([row["content"][HEADER_BYTES:]]), os.path.basename(row["path"]), row["tid"], header["first_tick"]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), arrow, strict=True)], schema=arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.trace").load(path).select("path", "content", F.xxhash64("path").alias("tid"))
    return files.mapInArrow(run, kind)


def write_traces(events: DataFrame, path: str, timer_us: int = 0) -> None:
    """One trace for each thread; call sites keep their low 16 bits."""
    spark = events.sparkSession
    spark.dataSource.register(TraceSource)
    rows = events.select("trace_id", "tid", "seq", "kind", "routine_id", "call_site", "ts", "tick")
    (rows.repartition("tid").sortWithinPartitions("tid", "seq").write.format("calltrace").option("timer_us", timer_us).mode("overwrite").save(path))
