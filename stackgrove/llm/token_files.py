"""Token-id files of fixed-width packed ids (operator 6).

A file is a row of blocks, each followed by one line feed. A block holds, little-endian:
magic (4 bytes), bits (u32), documents n (u64), ids m (u64), payload bytes (u64), the first
document's doc_id (i64, as a sort key), then n doc_ids (i64), n + 1 offsets into the block's ids (u64), and
the packed payload. Id i of a block takes bits i*bits to (i+1)*bits of the payload, lowest bit
first, so any run of ids is read by arithmetic alone. Blocks begin and end with documents; one of
more than BLOCK_IDS ids has a block to itself.

Files are written by Spark's text writer (raw bytes, one block a row) and read back by its
binary reader, so any file system that Spark knows can hold them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE, Scratch, rowwise, texts_of
from .encoding import Encoder

MAGIC = b"FWID"
HEADER = struct.Struct("<4sIQQQq")
#: Ids after which a block is closed, and text bytes dealt to one file.
BLOCK_IDS, FILE_BYTES = 1 << 20, 24 << 20


def width(vocabulary: int) -> int:
    """The fewest bits that hold every id below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    cells = (ids.astype("<u4")[:, None] >> np.arange(bits, dtype="<u4")) & 1
    return np.packbits(cells.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_ids(payload: bytes | memoryview, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of a payload; touches only the bytes that hold them."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", stop - start, start * bits // 8).astype("<u4")
    first, last = start * bits // 8, -(-stop * bits // 8)
    cells = np.unpackbits(np.frombuffer(payload, np.uint8, last - first, first), bitorder="little")
    cells = cells[start * bits - 8 * first :][: (stop - start) * bits].reshape(-1, bits)
    return cells.astype("<u4") @ (np.uint32(1) << np.arange(bits, dtype="<u4"))


def block(doc_ids: list[int], ids: list[bytes], bits: int) -> bytes:
    offsets = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype="<u8")
    payload = pack_ids(np.frombuffer(b"".join(ids), "<u4"), bits)
    head = HEADER.pack(MAGIC, bits, len(doc_ids), int(offsets[-1]), len(payload), doc_ids[0])
    return head + np.array(doc_ids, "<i8").tobytes() + offsets.tobytes() + payload


def blocks(content: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, int, memoryview]]:
    """doc_ids, offsets, bits and payload of each block of a file."""
    view, at = memoryview(content), 0
    while at < len(view):
        magic, bits, n, _, size, _ = HEADER.unpack_from(view, at)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at += HEADER.size
        doc_ids, offsets = np.frombuffer(view, "<i8", n, at), np.frombuffer(view, "<u8", n + 1, at + 8 * n)
        at += 16 * n + 8
        yield doc_ids, offsets, bits, view[at : at + size]
        at += size + 1


def write_token_files(docs: DataFrame, path: str, end_id: int = 2, vocabulary: str | None = None) -> None:
    """Encodes docs (doc_id, text) in ascending doc_id order into files under `path`.

    Rows of a null doc_id are left out (they have no place in the order); a null text is empty and
    gives the end id alone; rows that share a doc_id are all kept, next to each other, by text.
    """
    docs = texts_of(docs).filter("doc_id is not null")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = docs.repartitionByRange(max(1, -(-size // FILE_BYTES)), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail = Encoder(vocabulary), end_id.to_bytes(4, "little")
        bits = width(max(len(encoder.ending), end_id + 1))
        names: list[int] = []
        ids: list[bytes] = []
        held = 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block(names, ids, bits)], pa.binary())], ["block"])

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for row in batch.slice(at, SLICE).to_pylist():
                    x = encoder.ids(row["text"]) + tail
                    if names and held + len(x) // 4 > BLOCK_IDS:
                        yield closed()
                        names, ids, held = [], [], 0
                    names.append(row["doc_id"])
                    ids.append(x)
                    held += len(x) // 4
        if names:
            yield closed()

    ordered.mapInArrow(run, "block binary").select(F.col("block").cast("string").alias("value")).write.mode("overwrite").option("lineSep", "\n").text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of the files: file, place, doc_id, ids (little-endian u32 bytes)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def step():
        def work(rows: list[dict]) -> list[tuple]:
            out = []
            for row in rows:
                place = 0
                for doc_ids, offsets, bits, payload in blocks(row["content"]):
                    for i, doc_id in enumerate(doc_ids.tolist()):
                        out.append((row["path"], place, doc_id, unpack_ids(payload, bits, int(offsets[i]), int(offsets[i + 1])).tobytes()))
                        place += 1
            return out

        return work

    return rowwise(files, "file string, place long, doc_id long, ids binary", step)


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files under `path`.

    An empty folder gives no rows. start counts the ids of all documents before it, over all files.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def step():
        def work(rows: list[dict]) -> list[tuple]:
            out = []
            for row in rows:
                local = 0
                for doc_ids, offsets, bits, payload in blocks(row["content"]):
                    ids = memoryview(unpack_ids(payload, bits, 0, int(offsets[-1])).tobytes())
                    spans = offsets.astype(np.int64).tolist()
                    for i, doc_id in enumerate(doc_ids.tolist()):
                        a, b = spans[i], spans[i + 1]
                        out.append((row["path"], doc_id, local + a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
                    local += spans[-1]
            return out

        return work

    return rowwise(files, "file string, doc_id long, local long, n_tokens long, ids_crc32 long", step)


def token_files(docs: DataFrame, spark: SparkSession, vocabulary: str | None = None, end_id: int = 2) -> DataFrame:
    """Writes docs to token files in the shared folder and returns what the files say of each document.

    Empty input: no files and no rows. Texts of any length stay whole. Columns beside doc_id and
    text are not read, so their names can't clash.
    """
    scratch = Scratch(spark, "token-files")
    write_token_files(docs, scratch.path("files"), end_id, vocabulary)
    seen = scratch.table(token_digests(spark, scratch.path("files")), "digests")
    # one row a file: a few bytes for every FILE_BYTES of text
    files = seen.groupBy("file").agg(F.min("doc_id").alias("first"), F.sum("n_tokens").alias("n"))
    files = files.select("file", (F.sum("n").over(_by_first()) - F.col("n")).alias("base"))
    return seen.join(files, "file").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def _by_first():
    from pyspark.sql import Window

    return Window.orderBy("first", "file").rowsBetween(Window.unboundedPreceding, 0)
