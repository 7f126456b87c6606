"""Tree dumps, memory maps and symbols files read as tables.

A dump is text: two `c` lines (tool and parameters; command, thread, folder), one `v` line a node
in depth-first order, a `p` line with the counts. Ids are hexadecimal, counters decimal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import from_hex
from ..scratch import Scratch

#: The parameters that follow each tool's name.
TOOLS = {
    "cct": [],
    "cct-burst": ["sampling_interval", "burst_length", "exhaustive_enter_events"],
    "cct-time": ["sampling_interval", "thread_tics"],
    "lss-hcct": ["epsilon"],
    "lss-hcct-burst": ["epsilon", "sampling_interval", "burst_length", "exhaustive_enter_events"],
    "lss-hcct-time": ["epsilon", "sampling_interval", "thread_tics"],
}


class BadDump(ValueError):
    """A dump that doesn't hold together."""


def dump_lines(spark: SparkSession, path: str) -> DataFrame:
    """run_id (the file), tag and fields of each line."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("run_id"), "value").filter("trim(value) <> ''")
    return lines.select("run_id", F.substring("value", 1, 1).alias("tag"), F.split(F.trim(F.substring("value", 3, 1 << 20)), " +").alias("f"), "value")


def read_dumps(spark: SparkSession, path: str) -> DataFrame:
    """run_id, node_id, parent_id, counter, routine_id, call_site of each node; the root has parent 0."""
    v = dump_lines(spark, path).filter("tag = 'v'")
    hexes = {name: from_hex(F.col("f")[i]) for i, name in ((0, "node_id"), (1, "parent_id"), (3, "routine_id"), (4, "call_site"))}
    return v.select("run_id", *[c.alias(n) for n, c in hexes.items()], F.col("f")[2].cast("long").alias("counter"))


def read_runs(spark: SparkSession, path: str, dialect: str = "v2") -> DataFrame:
    """One row a dump: tool, its parameters, program, tid, folder, nodes and events of the trailer.

    dialect v1: epsilon and phi are integers, the reciprocals; they become fractions here. A decimal
    comma in epsilon is read as a point.
    """
    lines = dump_lines(spark, path)
    tools = F.map_from_entries(F.array(*[F.struct(F.lit(t), F.array(*[F.lit(p) for p in ps]) if ps else F.array().cast("array<string>")) for t, ps in TOOLS.items()]))
    heads = lines.filter("tag = 'c'")
    named = tools[F.col("f")[0]] if dialect == "v2" else F.array(F.lit("epsilon"), F.lit("phi"))
    given = F.least(F.size(named), F.size("f") - 1)
    parameters = F.map_from_arrays(F.slice(named, F.lit(1), given), F.slice("f", F.lit(2), given))
    tool = heads.filter(F.col("f")[0].isin(*TOOLS)).select("run_id", F.col("f")[0].alias("tool"), parameters.alias("_p"))
    where = heads.filter(~F.col("f")[0].isin(*TOOLS)).select("run_id", F.col("f")[0].alias("program_path"), F.col("f")[1].cast("long").alias("tid"), F.array_join(F.slice("f", 3, 1 << 10), " ").alias("folder"))
    tail = lines.filter("tag = 'p'").select("run_id", F.col("f")[0].cast("long").alias("nodes"), F.col("f")[1].cast("long").alias("events"))
    number = {n: F.regexp_replace(F.col("_p")[n], ",", ".").cast("double") for n in ("epsilon", "phi")}
    if dialect == "v1":
        number = {n: 1 / c for n, c in number.items()}
    rows = tool.join(where, "run_id", "left").join(tail, "run_id", "left")
    whole = ["sampling_interval", "burst_length", "exhaustive_enter_events", "thread_tics"]
    return rows.select("run_id", "tool", *[c.alias(n) for n, c in number.items()], *[F.col("_p")[n].cast("long").alias(n) for n in whole], "program_path", "tid", "folder", "nodes", "events")


def checked(nodes: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id and problem of dumps with a wrong node count, a missing parent, no root or several, or a bad root."""
    count = nodes.groupBy("run_id").agg(F.count("*").alias("n"), F.sum((F.col("parent_id") == 0).cast("int")).alias("roots"))
    wrong = runs.join(count, "run_id", "left").filter("n is null or n <> nodes").select("run_id", F.lit("node count").alias("problem"))
    roots = count.filter("roots <> 1").select("run_id", F.lit("roots").alias("problem"))
    parents = nodes.select("run_id", F.col("node_id").alias("parent_id"))
    lost = nodes.filter("parent_id <> 0").join(parents, ["run_id", "parent_id"], "left_anti").select("run_id", F.lit("missing parent").alias("problem")).distinct()
    bad = nodes.filter("parent_id = 0 and (counter <> 1 or routine_id <> 0 or call_site <> 0)").select("run_id", F.lit("bad root").alias("problem"))
    return wrong.unionByName(roots).unionByName(lost).unionByName(bad)


def with_paths(nodes: DataFrame, levels: int = 1 << 20) -> DataFrame:
    """run_id, node_id, path, depth, counter and ids of all nodes but the root: parents are resolved by self-joins on ids.

    Each step doubles the length of the known chains (a node's path from its ancestor 2**k above)
    and is written to a scratch table; steps end with the first that leaves no chain below its root, after about log2 of the depth.
    """
    scratch = Scratch(nodes.sparkSession, "dump-paths")
    own = F.concat(F.lower(F.hex("routine_id")), F.lit("@"), F.lower(F.hex("call_site")))
    ids = ["counter", "routine_id", "call_site"]
    roots = nodes.filter("parent_id = 0").select("run_id", F.col("node_id").alias("up"))
    chains = scratch.table(nodes.filter("parent_id <> 0").select("run_id", "node_id", F.col("parent_id").alias("up"), own.alias("path"), *ids), "chains-1")
    reach = 1
    while reach < levels and not chains.join(roots, ["run_id", "up"], "left_anti").isEmpty():
        above = chains.select("run_id", F.col("node_id").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        joined = chains.join(above, ["run_id", "up"], "left")
        reach *= 2
        chains = scratch.table(joined.select("run_id", "node_id", F.coalesce("_up", "up").alias("up"), F.concat_ws("/", "_path", "path").alias("path"), *ids), f"chains-{reach}")
        scratch.drop(f"chains-{reach // 2}")
    return chains.join(roots, ["run_id", "up"], "left_semi").select("run_id", "node_id", "path", F.size(F.split("path", "/")).alias("depth"), *ids)


def read_maps(spark: SparkSession, path: str) -> DataFrame:
    """start_addr, end_addr, offset, pathname of each line of memory maps; no path is <unknown>."""
    pattern = r"^([0-9a-fA-F]+)-([0-9a-fA-F]+)\s+\S+\s+([0-9a-fA-F]+)\s+\S+\s+\S+\s*(.*)$"
    part = [F.regexp_extract("value", pattern, i) for i in (1, 2, 3, 4)]
    lines = spark.read.text(path).filter(F.col("value").rlike(pattern))
    name = F.when(F.trim(part[3]) == "", "<unknown>").otherwise(F.trim(part[3]))
    return lines.select(from_hex(part[0]).alias("start_addr"), from_hex(part[1]).alias("end_addr"), from_hex(part[2]).alias("offset"), name.alias("pathname"))


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    """run_id, program, maps_file, address, name, file, image, offset of symbols files: three head lines, five lines a symbol.

    A file whose count of symbols is not that of its lines raises an error.
    """
    whole = spark.read.text(path, wholetext=True).filter("value <> ''").select(F.col("_metadata.file_path").alias("run_id"), F.split(F.regexp_replace("value", r"\n+$", ""), "\n").alias("l"))
    n = F.get("l", F.lit(2)).cast("int")
    wrong = F.raise_error(F.concat(F.lit("bad symbols file "), F.col("run_id"))).cast("array<string>")
    whole = whole.withColumn("l", F.when(F.size("l") == 3 + 5 * n, F.col("l")).otherwise(wrong))
    head = whole.select("run_id", F.regexp_replace(F.col("l")[0], r"^\[program\] ", "").alias("program"), F.regexp_replace(F.col("l")[1], r"^\[maps_file\] ", "").alias("maps_file"), n.alias("n"), "l")
    each = head.filter("n > 0").select("run_id", "program", "maps_file", "l", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    line = lambda k: F.get("l", F.lit(3) + F.col("i") * 5 + k)
    return each.select("run_id", "program", "maps_file", from_hex(line(0)).alias("address"), line(1).alias("name"), line(2).alias("file"), line(3).alias("image"), from_hex(line(4)).alias("offset"))


def read_addresses(spark: SparkSession, path: str) -> DataFrame:
    """Regions of *.map and *.maps files, symbols of *.sym and *.syms files."""
    if path.endswith((".map", ".maps")):
        return read_maps(spark, path)
    if path.endswith((".sym", ".syms")):
        return read_symbols(spark, path)
    raise ValueError(f"neither a memory map nor a symbols file: {path}")
