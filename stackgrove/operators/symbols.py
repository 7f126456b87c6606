"""Addresses to regions and symbols."""

from __future__ import annotations

import itertools
import subprocess
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import DUMMY

#: Asked with an image's path and some offsets in it, gives a name and a file of each.
Resolver = Callable[[str, list[int]], list[tuple[str, str]]]

#: Bits of an address within a page; regions are looked up by page.
PAGE_BITS = 12
#: Pages of a region that are listed one by one; larger regions are listed by blocks of as many pages, and so on.
FAN = 4096


def in_regions(addresses: DataFrame, regions: DataFrame, address: str = "address") -> DataFrame:
    """Each distinct address with the region that holds it (both ends inclusive, the lowest start of several), or nulls.

    The range join is made an equi-join: a region is listed under the pages it touches, at the
    coarsest of three page sizes that gives few of them, and an address looks under its page of
    each size.
    """
    sizes = [PAGE_BITS + 12 * k for k in range(4)]
    span = F.col("end_addr") - F.col("start_addr")
    bits = F.lit(sizes[-1])
    for b in reversed(sizes[:-1]):
        bits = F.when(span < F.lit(FAN << b), b).otherwise(bits)
    listed = regions.withColumn("_bits", bits).withColumn("_page", F.explode(F.sequence(F.expr("shiftright(start_addr, _bits)"), F.expr("shiftright(end_addr, _bits)"))))
    wanted = addresses.select(F.col(address).alias("address")).distinct()
    looked = wanted.select("address", F.explode(F.array(*[F.lit(b) for b in sizes])).alias("_bits")).withColumn("_page", F.expr("shiftright(address, _bits)"))
    hits = looked.join(listed, ["_bits", "_page"]).filter("address between start_addr and end_addr")
    best = hits.groupBy("address").agg(F.min(F.struct("start_addr", "end_addr", "offset", "pathname")).alias("r")).select("address", "r.*")
    return wanted.join(best, "address", "left")


def with_symbols(nodes: DataFrame, symbols: DataFrame, columns: dict[str, str]) -> DataFrame:
    """nodes with `<prefix>_name/file/image/offset` of each address column in `columns` (column: prefix), and
    `<prefix>_missing` where the table has none. Address 0 is the dummy symbol."""
    dummy = symbols.sparkSession.createDataFrame([(0, DUMMY, DUMMY, DUMMY, 0)], "address long, name string, file string, image string, offset long")
    table = symbols.select("address", "name", "file", "image", "offset").filter("address <> 0").unionByName(dummy).dropDuplicates(["address"])
    for column, prefix in columns.items():
        named = table.select(F.col("address").alias(column), *[F.col(c).alias(f"{prefix}_{c}") for c in ("name", "file", "image", "offset")], F.lit(True).alias("_known"))
        nodes = nodes.join(named, column, "left").withColumn(f"{prefix}_missing", F.col("_known").isNull()).drop("_known")
    return nodes


def routine_address(path: Column) -> Column:
    return F.substring_index(F.element_at(F.split(path, "/"), -1), "@", 1)


def resolve(addresses: DataFrame, regions: DataFrame, symbols: DataFrame) -> DataFrame:
    """address, name, file, image, offset of distinct addresses: by the table, else UNKNOWN in its region's image.

    The offset is the address's place in the region's file, or null outside all regions.
    """
    placed = in_regions(addresses, regions)
    known = symbols.select("address", F.col("name").alias("_n"), F.col("file").alias("_f")).dropDuplicates(["address"])
    rows = placed.join(known, "address", "left")
    return rows.select("address", F.coalesce("_n", F.lit("UNKNOWN")).alias("name"), F.coalesce("_f", F.lit("UNKNOWN")).alias("file"), F.coalesce("pathname", F.lit("UNKNOWN")).alias("image"), (F.col("address") - F.col("start_addr") + F.col("offset")).alias("offset"))


def addr2line(image: str, offsets: list[int], command: str = "addr2line") -> list[tuple[str, str]]:
    """A Resolver that runs the tool of that name where the images are."""
    out = subprocess.run([command, "-f", "-e", image, *map(hex, offsets)], capture_output=True, text=True, check=True).stdout.split("\n")
    return [(name, place.rpartition(":")[0]) for name, place in itertools.batched(out[: 2 * len(offsets)], 2)]


def asked(placed: DataFrame, resolver: Resolver) -> DataFrame:
    """address, name, file of addresses placed by in_regions(), from a resolver; those in no region are left out.

    Each batch is asked an image at a time, where the rows are; null names stay unknown.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sorted(zip(*(batch.column(c).to_pylist() for c in ("pathname", "at", "address")), strict=True))
            for image, group in itertools.groupby(rows, key=lambda r: r[0]):
                of = list(group)
                names, files = zip(*resolver(image, [r[1] for r in of]), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([r[2] for r in of], pa.int64()), pa.array(names, pa.string()), pa.array(files, pa.string())], ["address", "name", "file"])

    at = (F.col("address") - F.col("start_addr") + F.col("offset")).alias("at")
    return placed.filter("pathname is not null").select("pathname", at, "address").mapInArrow(run, "address long, name string, file string")
