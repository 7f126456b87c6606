"""Text forms of trees and symbols: dumps, GraphViz, nested JSON, an indented list, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import parent_path


def node_ids(nodes: DataFrame) -> DataFrame:
    """Adds node_id and parent_id: hashes of the paths, the root's being that of ''."""
    return nodes.withColumns({"node_id": F.xxhash64("path"), "parent_id": F.xxhash64(parent_path(F.col("path")))})


def dump_lines(nodes: DataFrame) -> DataFrame:
    """path and line of each node but the root, in the form a dump has; ordered by path they are in depth-first order.

    Ids are the node's and its parent's path by MD5's first 16 digits, so that they mean the same in any engine.
    """
    key = lambda c: F.substring(F.md5(c.cast("binary")), 1, 16)
    last = F.element_at(F.split("path", "/"), -1)
    parent = parent_path(F.col("path"))
    line = F.concat_ws(" ", F.lit("v"), key(F.col("path")), key(parent), F.col("counter").cast("string"), F.substring_index(last, "@", 1), F.substring_index(last, "@", -1))
    return nodes.select("path", line.alias("line"))


def write_dump(nodes: DataFrame, folder: str, tool: str, parameters: list, command: str, tid: int, cwd: str, events: int | None = None) -> None:
    """A dump as one text file in `folder`; nodes need path, counter, routine_id, call_site (numbers).

    events: the enters of the run, which the last line gives; an exact tree's counters sum up to them, a sketch's or a
    sampled tree's don't. Rows are sorted by path frames, so the file is in depth-first order; it is one file by format.
    """
    spark = nodes.sparkSession
    own = node_ids(nodes)
    hexes = lambda c: F.lower(F.hex(c))
    v = own.select(F.concat(F.lit("1"), F.replace("path", F.lit("/"), F.lit("\x01"))).alias("o"), F.concat_ws(" ", F.lit("v"), hexes("node_id"), hexes("parent_id"), F.col("counter").cast("string"), hexes("routine_id"), hexes("call_site")).alias("value"))
    head = spark.createDataFrame([("0a", " ".join(["c", tool, *map(str, parameters)]) + ("" if parameters else " ")), ("0b", f"c {command} {tid} {cwd}")], "o string, value string")
    root = spark.range(1).select(F.lit("0c").alias("o"), F.concat(F.lit("v "), hexes(F.xxhash64(F.lit(""))), F.lit(" 0 1 0 0")).alias("value"))
    tail = nodes.agg(F.lit("2").alias("o"), F.concat_ws(" ", F.lit("p"), (F.count("*") + 1).cast("string"), (F.coalesce(F.sum("counter"), F.lit(0)) if events is None else F.lit(events)).cast("string")).alias("value"))
    head.unionByName(root).unionByName(v).unionByName(tail).coalesce(1).sortWithinPartitions("o").select("value").write.mode("overwrite").text(folder)


def graphviz_lines(nodes: DataFrame, name: Column | None = None) -> DataFrame:
    """path and line: of each node its label and the edge from its parent with the number of calls."""
    label = F.substring_index(F.element_at(F.split("path", "/"), -1), "@", 1) if name is None else name
    quote = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    parent = F.when(parent_path(F.col("path")) == "", "root").otherwise(parent_path(F.col("path")))
    line = F.concat(quote(F.col("path")), F.lit(" [label="), quote(label), F.lit("]; "), quote(parent), F.lit(" -> "), quote(F.col("path")), F.lit(' [label="calls: '), F.col("counter").cast("string"), F.lit('"];'))
    return nodes.select("path", line.alias("line"))


def write_graphviz(nodes: DataFrame, folder: str, name: Column | None = None) -> None:
    spark = nodes.sparkSession
    ends = spark.createDataFrame([("0", "digraph {"), ("0a", '"root" [label="<root>"];'), ("2", "}")], "o string, value string")
    body = graphviz_lines(nodes, name).select(F.concat(F.lit("1"), "path").alias("o"), F.col("line").alias("value"))
    ends.unionByName(body).coalesce(1).sortWithinPartitions("o").select("value").write.mode("overwrite").text(folder)


def json_tree(nodes: DataFrame) -> DataFrame:
    """name and json of the subtrees at depth 1, nested {"name", "children"} down to the leaves, siblings in order.

    In depth-first order a node's text opens its object and closes as many as the next node lies above it, so
    one window by subtree gives all texts. A subtree is one value, and so one task's.
    """
    parts = F.split("path", "/")
    name = F.replace(F.replace(F.element_at(parts, -1), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    rows = nodes.select(parts[0].alias("name"), F.transform(parts, lambda x: F.concat(x, F.lit('"'))).alias("_o"), F.size(parts).alias("_depth"), name.alias("_name"))
    then = F.lead("_depth").over(Window.partitionBy("name").orderBy("_o"))
    up = F.col("_depth") - F.coalesce(then, F.lit(1)) + 1  # objects that end with this node
    text = F.concat(F.lit('{"name":"'), "_name", F.lit('","children":['), F.repeat(F.lit("]}"), up), F.when(then.isNotNull() & (up > 0), ",").otherwise(""))
    listed = rows.withColumn("_text", text).groupBy("name").agg(F.sort_array(F.collect_list(F.struct("_o", "_text"))).alias("l"))
    return listed.select("name", F.array_join(F.transform("l", lambda x: x["_text"]), "").alias("json"))


def json_document(nodes: DataFrame, root: str = "0") -> DataFrame:
    """One row, json: the whole tree as the root's object. One document is one value, so it suits trees that fit a task."""
    inner = json_tree(nodes).agg(F.array_join(F.array_sort(F.collect_list("json")), ",").alias("inner"))
    return inner.select(F.concat(F.lit(f'{{"name":"{root}","children":['), "inner", F.lit("]}")).alias("json"))


def indented(nodes: DataFrame) -> DataFrame:
    """path and line: a sign for each level, then the frame and its counter."""
    return nodes.select("path", F.concat(F.repeat(F.lit("="), F.col("depth")), F.lit(" "), F.element_at(F.split("path", "/"), -1), F.lit(" "), F.col("counter").cast("string")).alias("line"))


def append_log(metrics: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Adds a metrics row to a log folder of CSV files, or starts the log anew; only the first file has a header."""
    context = metrics.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    begun = not overwrite and path.getFileSystem(context._jsc.hadoopConfiguration()).exists(path)
    metrics.coalesce(1).write.mode("overwrite" if overwrite else "append").option("header", not begun).csv(folder)


def write_symbols(symbols: DataFrame, folder: str, program: str, maps_file: str) -> None:
    """A symbols file: head lines, the count, five lines a symbol in order of address."""
    spark = symbols.sparkSession
    w = Window.orderBy("address")
    each = symbols.select(F.row_number().over(w).alias("o"), F.array(F.lower(F.hex("address")), "name", "file", "image", F.lower(F.hex("offset"))).alias("l"))
    lines = each.select("o", F.array_join("l", "\n").alias("value"))
    count = symbols.agg(F.lit(0).alias("o"), F.concat(F.lit(f"[program] {program}\n[maps_file] {maps_file}\n"), F.count("*").cast("string")).alias("value"))
    count.unionByName(lines).coalesce(1).sortWithinPartitions("o").select("value").write.mode("overwrite").text(folder)
