"""Round trips of traces, dumps and symbols files, and their errors."""

import json

import pytest
from pyspark.sql import functions as F

from stackgrove.functions import columns
from stackgrove.operators import matching, symbols, trees
from stackgrove.params import BurstParams, SketchParams, dump_folder
from stackgrove.sinks import texts
from stackgrove.sources import dumps, traces


def test_trace_codec():
    rows = [{"kind": "ENTER", "routine_id": 7, "call_site": 3}, {"kind": "TICK", "routine_id": None, "call_site": None}, {"kind": "ENTER", "routine_id": 9, "call_site": 0}, {"kind": "EXIT", "routine_id": None, "call_site": None}]
    raw = traces.encode(iter(rows), 200)
    head = traces.parse_header(raw)
    assert (head["enters"], head["exits"], head["ticks"], head["timer_us"]) == (2, 1, 1, 200)
    body = raw[traces.HEADER.size :]
    for size in (1, 2, 5, 100):
        got = list(traces.decode((body[i : i + size] for i in range(0, len(body), size)), "x", 1))
        assert [(r[3], r[4], r[5], r[7]) for r in got] == [("ENTER", 7, 3, 0), ("TICK", None, None, 0), ("ENTER", 9, 0, 1), ("EXIT", None, None, 1)]
    for bad in (b"\x02abcd", body[:3]):
        with pytest.raises(traces.BadTrace):
            list(traces.decode(iter([bad]), "x", 1))
    with pytest.raises(traces.BadTrace):
        traces.parse_header(b"\0" * 40)


def test_trace_files(spark, tmp_path):
    rows = [("t", t, i, "ENTER" if i % 3 else "TICK", 5 + i if i % 3 else None, i if i % 3 else None, None, 0) for t in (1, 2) for i in range(9)]
    df = spark.createDataFrame(rows, traces.SCHEMA)
    traces.write_traces(df, str(tmp_path / "t"))
    for read in (traces.read_traces, traces.read_traces_any):
        got = read(spark, str(tmp_path / "t")).groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "routine_id", "call_site"))).alias("r")).collect()
        assert len(got) == 2
        for g in got:
            assert [tuple(x) for x in g["r"]] == [(r[2], r[3], r[4], r[5]) for r in rows[:9]]


def test_dump_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("1@a", 4, 1, 10), ("1@a/2@b", 3, 2, 11), ("3@c", 2, 3, 12)], "path string, counter long, routine_id long, call_site long")
    texts.write_dump(nodes, str(tmp_path / "d"), "lss-hcct", [0.001], "prog", 17, "/home/x")
    got = dumps.read_dumps(spark, str(tmp_path / "d"))
    runs = dumps.read_runs(spark, str(tmp_path / "d"))
    run = runs.first()
    assert (run["tool"], run["epsilon"], run["tid"], run["nodes"], run["events"]) == ("lss-hcct", 0.001, 17, 4, 9)
    assert dumps.checked(got, runs).count() == 0
    paths = {(r["path"], r["counter"]) for r in dumps.with_paths(got).collect()}
    assert paths == {("1@a", 4), ("1@a/2@b", 3), ("3@c", 2)}
    lost = dumps.checked(got.filter("routine_id <> 1"), runs)
    assert {r["problem"] for r in lost.collect()} == {"node count", "missing parent"}


def test_sketch_dump_gives_the_enters(spark, tmp_path):
    nodes = spark.createDataFrame([("1@a", 4, 1, 10)], "path string, counter long, routine_id long, call_site long")
    texts.write_dump(nodes, str(tmp_path / "d"), "lss-hcct", [0.001], "prog", 17, "/home/x", events=77)
    assert dumps.read_runs(spark, str(tmp_path / "d")).first()["events"] == 77


def test_json_document_has_the_root(spark):
    nodes = trees.exact_tree(spark.createDataFrame([("a",), ("a/b",), ("d",)], "path string"))
    whole = json.loads(texts.json_document(nodes).first()["json"])
    assert whole == {"name": "0", "children": [{"name": "a", "children": [{"name": "b", "children": []}]}, {"name": "d", "children": []}]}


def test_log_has_one_header(spark, tmp_path):
    row, folder = spark.createDataFrame([(1, 2)], "a long, b long"), str(tmp_path / "log")
    for _ in range(3):
        texts.append_log(row, folder)
    lines = [r["value"] for r in spark.read.text(folder).collect()]
    assert sorted(lines) == ["1,2", "1,2", "1,2", "a,b"]
    texts.append_log(row, folder, overwrite=True)
    assert sorted(r["value"] for r in spark.read.text(folder).collect()) == ["1,2", "a,b"]


def test_graphviz_file(spark, tmp_path):
    texts.write_graphviz(trees.exact_tree(spark.createDataFrame([("a",), ("a/b",)], "path string")), str(tmp_path / "g"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "g")).collect()]
    assert lines[0] == "digraph {" and lines[-1] == "}" and any('"a" -> "a/b"' in x for x in lines) and len(lines) == 5


def test_column_functions(spark):
    rows = spark.createDataFrame([("./x/y.c", "g", "f.c", "i", 5), ("y.c", "UNRSLVD", "f.c", "a", 1), ("/y.c", "UNRSLVD", "f.c", "a", 0)], "path string, name string, file string, image string, offset long")
    assert [r[0] for r in rows.select(columns.base_name(F.col("path"))).collect()] == ["y.c"] * 3
    ordered = rows.orderBy(*columns.symbol_order(*(F.col(c) for c in ("name", "file", "image", "offset"))))
    assert [(r["name"], r["offset"]) for r in ordered.collect()] == [("UNRSLVD", 0), ("UNRSLVD", 1), ("g", 5)]


def test_parameters_of_runs():
    assert BurstParams.from_environment({}) == BurstParams(20_000_000, 2_000_000)
    assert BurstParams.from_environment({"SINTVL": "0x64", "BLENGTH": "50"}) == BurstParams(100, 50)
    assert BurstParams.from_environment({"SINTVL": "0", "BLENGTH": "x"}) == BurstParams(20_000_000, 2_000_000)
    assert BurstParams.from_arguments(["trace", "-sampling", "60", "-burst", "3"]) == BurstParams(60, 3)
    assert (dump_folder({}), dump_folder({"DUMPPATH": "/d"})) == ("/tmp", "/d")
    assert SketchParams.from_environment({"EPSILON": "0.01"}).epsilon == 0.01 and SketchParams.from_environment({"EPSILON": "7"}).epsilon == 1 / 50000


def test_older_dump(spark, tmp_path):
    (tmp_path / "x.tree").write_text("c lss-hcct 50000 10000\nc prog 3 /tmp\nv 1 0 1 0 0\nv 2 1 5 a b\np 2 5\n")
    run = dumps.read_runs(spark, str(tmp_path), "v1").first()
    assert (run["epsilon"], run["phi"]) == (1 / 50000, 1 / 10000)


def test_symbols_and_maps(spark, tmp_path):
    table = spark.createDataFrame([(16, "f", "f.c", "prog", 1), (32, "g", "g.c", "lib", 2)], "address long, name string, file string, image string, offset long")
    texts.write_symbols(table, str(tmp_path / "s"), "/bin/p", "p.maps")
    got = dumps.read_symbols(spark, str(tmp_path / "s"))
    assert {tuple(r) for r in got.select("address", "name", "file", "image", "offset").collect()} == {tuple(r) for r in table.collect()}
    (tmp_path / "m.maps").write_text("10-1f r-xp 00000002 08:01 1 /bin/p\n1f-30 r-xp 0 08:01 2\n[junk]\n")
    regions = dumps.read_addresses(spark, str(tmp_path / "m.maps"))
    asked = spark.createDataFrame([(16,), (31,), (48,), (99,)], "address long")
    found = {r["address"]: r["pathname"] for r in symbols.in_regions(asked, regions).collect()}
    assert found == {16: "/bin/p", 31: "/bin/p", 48: "<unknown>", 99: None}
    whole = {r["address"]: (r["name"], r["image"], r["offset"]) for r in symbols.resolve(asked, regions, table).collect()}
    assert whole[16] == ("f", "/bin/p", 2) and whole[99] == ("UNKNOWN", "UNKNOWN", None)
    with pytest.raises(ValueError):
        dumps.read_addresses(spark, "x.txt")


def test_large_region(spark):
    regions = spark.createDataFrame([(0, 1 << 45, 0, "big"), (1 << 46, (1 << 46) + 5, 0, "small")], "start_addr long, end_addr long, offset long, pathname string")
    asked = spark.createDataFrame([(1 << 44,), ((1 << 46) + 5,), ((1 << 46) + 6,)], "address long")
    assert {r["address"]: r["pathname"] for r in symbols.in_regions(asked, regions).collect()} == {1 << 44: "big", (1 << 46) + 5: "small", (1 << 46) + 6: None}


def test_json_tree(spark):
    nodes = trees.exact_tree(spark.createDataFrame([("a",), ("a/b",), ("a/c",), ("d",)], "path string"))
    got = {r["name"]: json.loads(r["json"]) for r in texts.json_tree(nodes).collect()}
    assert got["a"] == {"name": "a", "children": [{"name": "b", "children": []}, {"name": "c", "children": []}]}


def test_assignments():
    import itertools
    import random

    r = random.Random(5)
    for _ in range(60):
        n, m = r.randint(1, 4), r.randint(1, 5)
        scores = [[r.choice([0, 0.1, 0.5, r.random()]) for _ in range(m)] for _ in range(n)]
        got = matching.best_assignment(scores)
        total = sum(scores[i][c] for i, c in enumerate(got) if c >= 0)
        taken = [c for c in got if c >= 0]
        assert len(taken) == len(set(taken)) == min(n, m)
        small, wide = (scores, m) if n <= m else ([list(c) for c in zip(*scores)], n)
        best = max(sum(small[i][c] for i, c in enumerate(p)) for p in itertools.permutations(range(wide), len(small)))
        assert abs(total - best) < 1e-9
    assert matching.greedy_assignment([[0.2, 0.9], [0.8, 0.9]], [[0, 0], [0, 0]]) == [1, 0]


def test_identical_trees_match_fully(spark):
    nodes = trees.exact_tree(spark.createDataFrame([("a@0",), ("a@0/b@1",), ("a@0/c@1",), ("a@0/c@1",), ("d@0",)], "path string"))
    same = matching.described(nodes).cache()
    got = matching.match_trees(same, same).collect()
    assert all(r["first_path"] == r["second_path"] and abs(r["score"] - 1) < 1e-9 for r in got) and len(got) == 5
    empty = same.filter("false")
    lost = matching.match_trees(same, empty).filter("first_path <> ''").collect()
    assert {r["status"] for r in lost} == {matching.NOT_MATCHED} and len(lost) == 4
