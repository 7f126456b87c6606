"""Column functions: frames and paths, hexadecimal numbers, file names, similarity of symbols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of equal parts of a symbol, and of the counter, in hundredths; and of the greedy heuristic.
PART, COUNTER, HEURISTIC = 10, 0.20, 0.15
UNKNOWN, UNRESOLVED, DUMMY = "UNKNOWN", "UNRSLVD", "<dummy>"


def escape(name: Column) -> Column:
    """A routine's name with the characters that separate frames and call sites written as %xx."""
    for sign, code in (("%", "%25"), ("/", "%2F"), ("@", "%40")):
        name = F.replace(name, F.lit(sign), F.lit(code))
    return name


def frame(routine: Column, call_site: Column) -> Column:
    return F.concat(escape(routine.cast("string")), F.lit("@"), call_site.cast("string"))


def parent_path(path: Column) -> Column:
    """The path less its last frame: '' for a top frame, null for the root."""
    return F.when(path == "", None).otherwise(F.regexp_replace(path, "/?[^/]*$", ""))


def depth_of(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/")))


def prefixes(path: Column) -> Column:
    """The paths of a node and all its ancestors but the root."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def from_hex(text: Column) -> Column:
    """A number of up to 64 bits; from 2**63 on it is the negative long of the same bits."""
    return F.conv(F.regexp_replace(text, "^0[xX]", ""), 16, -10).cast("long")


def to_hex(number: Column) -> Column:
    return F.lower(F.hex(number))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _resolved(value: Column) -> Column:
    return ~F.coalesce(value, F.lit(UNRESOLVED)).isin(UNKNOWN, UNRESOLVED)


def symbol_score(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """0 to 4 parts of PART each for equal image, offset, name and file; a and b have these four.

    An unknown name gives 0. The image must be resolved and equal for any part to count, the name
    resolved and equal for the file to.
    """
    image = _resolved(a["image"]) & (a["image"] == b["image"])
    name = _resolved(a["name"]) & (a["name"] == b["name"])
    parts = F.lit(PART) + F.when(a["offset"] == b["offset"], PART).otherwise(0) + F.when(name, F.lit(PART) + F.when(a["file"] == b["file"], PART).otherwise(0)).otherwise(0)
    unknown = (F.coalesce(a["name"], F.lit(UNKNOWN)) == UNKNOWN) | (F.coalesce(b["name"], F.lit(UNKNOWN)) == UNKNOWN)
    return F.when(unknown, 0).when(image, parts).otherwise(0)


def counter_score(first: Column, second: Column, adjust: Column) -> Column:
    """COUNTER less its share that the counters differ by; 0 where they differ by the first or more, or it is 0."""
    ratio = F.floor(F.abs(first - adjust * second)) / first
    return F.when((first > 0) & (ratio < 1), F.lit(COUNTER) * (1 - ratio)).otherwise(0.0)


def heuristic_score(first: Column, second: Column, adjust: Column) -> Column:
    """HEURISTIC for subtrees of like weight; 0 where the first weighs nothing or they differ by it or more."""
    ratio = F.abs(first - adjust * second) / first
    return F.when((first > 0) & (ratio < 1), F.lit(HEURISTIC) * (1 - ratio)).otherwise(0.0)


def symbol_order(name: Column, file: Column, image: Column, offset: Column) -> list[Column]:
    """Sort keys of symbols: by name, then unresolved ones by image and offset, others by file."""
    resolved = _resolved(name)
    return [name, F.when(resolved, file).otherwise(image), F.when(resolved, F.lit(0)).otherwise(offset)]
