"""Sequences of at most `capacity` tokens by bounded-space best fit (operator 2).

Bins that are open are kept in one integer whose bit f is set while a bin with f free tokens is
open, so the tightest bin that fits is its lowest set bit at or above the need. A fixed number of
bins is open; to open one more, the fullest closes.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Scratch, rowwise, texts_of
from .encoding import Encoder

CAPACITY, OPEN_BINS = 4096, 64
#: Tokens packed by one task: about 3,000 sequences, so what its last open bins leave free is a small part of them.
TASK_TOKENS = 12 << 20


class BestFit:
    """place(n) gives (bin, offset) for an item of n units, 0 < n <= capacity."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.most, self.count, self.made = capacity, open_bins, 0, 0
        self.free = 0
        self.bins: dict[int, list[int]] = defaultdict(list)

    def _take(self, room: int) -> int:
        stack = self.bins[room]
        found = stack.pop()
        if not stack:
            self.free ^= 1 << room
        self.count -= 1
        return found

    def place(self, n: int) -> tuple[int, int]:
        if not 0 < n <= self.capacity:
            raise ValueError(f"an item of {n} does not fit {self.capacity}")
        fitting = self.free >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            found = self._take(room)
        else:
            if self.count >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)
            room, found = self.capacity, self.made
            self.made += 1
        left = room - n
        if left:
            self.bins[left].append(found)
            self.free |= 1 << left
            self.count += 1
        return found, self.capacity - room


def token_pieces(docs: DataFrame, vocabulary: str | None = None, end_id: int = 1, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if kept) of each document's pieces.

    A null text is empty and gives the end id alone; rows that share a doc_id give rows each.
    """

    def step():
        encoder, tail = Encoder(vocabulary), end_id.to_bytes(4, "little")

        def work(rows: list[dict]) -> list[tuple]:
            out = []
            for row in rows:
                ids = encoder.ids(row["text"]) + tail
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((row["doc_id"], k, at // 4, len(part) // 4, zlib.crc32(part), *([part] if keep_ids else [])))
            return out

        return work

    return rowwise(texts_of(docs), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids, step)


def pack(pieces: DataFrame, spark: SparkSession, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...); every other column passes.

    `pieces` is read twice, so hand over a written table. Pieces are dealt evenly by a hash of their
    key to tasks of about TASK_TOKENS tokens. There they arrive in the order of that hash, which depends on
    the rows alone, so that a lost task gives the same rows again, and each is placed as it comes. Rows of one
    key are dealt as equals. No rows: no rows.
    """
    total = pieces.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-total // TASK_TOKENS))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    arrow = to_arrow_schema(schema)
    key = F.xxhash64("doc_id", "piece", "length")
    dealt = pieces.withColumn("_task", F.pmod(key, F.lit(tasks)).cast("int")).repartition(tasks, "_task")
    ordered = dealt.sortWithinPartitions("_task", key, "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bins = None, None
        for batch in batches:
            columns = {n: batch.column(n) for n in schema.names[:-2]}
            places = []
            for task, n in zip(batch.column("_task").to_pylist(), columns["length"].to_pylist(), strict=True):
                if task != now:
                    now, bins = task, BestFit(capacity, open_bins)
                found, offset = bins.place(n)
                places.append(((task << 40) + found, offset))
            if places:
                ids, offsets = zip(*places, strict=True)
                yield pa.RecordBatch.from_arrays([*(c.cast(arrow.field(n).type) for n, c in columns.items()), pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())], schema=arrow)

    return ordered.mapInArrow(run, schema)


def packed_documents(docs: DataFrame, spark: SparkSession, vocabulary: str | None = None, end_id: int = 1, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Where each piece of each document lies: token_pieces() and then pack().

    A null or empty text is its end id alone; a text of any length is cut only where it passes `capacity`.
    Rows that share a doc_id are packed each. Columns but doc_id and text are not read. No rows: no rows.
    """
    pieces = Scratch(spark, "packing").table(token_pieces(docs, vocabulary, end_id, capacity), "pieces")
    return pack(pieces, spark, capacity, open_bins)
