"""Offline requests over dumps."""

import pytest

from stackgrove.operators import metrics, sampling, symbols
from stackgrove.params import BurstParams
from stackgrove.plans import reports
from stackgrove.sinks import texts
from stackgrove.sources import dumps


@pytest.fixture(scope="module")
def dump(spark, tmp_path_factory):
    nodes = spark.createDataFrame([("10@a0", 90, 16, 160), ("10@a0/20@b0", 60, 32, 176), ("10@a0/30@b1", 2, 48, 177), ("40@c0", 30, 64, 192)], "path string, counter long, routine_id long, call_site long")
    out = tmp_path_factory.mktemp("dumps")
    texts.write_dump(nodes, str(out / "cct"), "cct", [], "prog", 1, "/")
    texts.write_dump(nodes.filter("counter > 2"), str(out / "lss"), "lss-hcct", [0.01], "prog", 1, "/")
    return out


def test_analyse(spark, dump):
    row, tree = reports.analyse(spark, str(dump / "cct"), 0.3)
    got = row.first()
    assert (got["nodes"], got["sum_counters"], got["hottest"], got["hot_nodes"], got["threshold"], got["n_routines"]) == (5, 183, 90, 2, 54, 4)
    assert tree.count() == 4


def test_compare(spark, dump):
    got = reports.compare(spark, str(dump / "cct"), str(dump / "lss"), phi=0.1)
    matched = {r["first_path"]: r["second_path"] for r in got["matches"].collect()}
    assert matched["10@a0/20@b0"] == "10@a0/20@b0" and matched["10@a0/30@b1"] is None
    assert got["uncovered"].first()["max"] == 2
    assert got["partition"].first()["hot"] == 3
    assert got["accuracy"].first()["matched"] == 3
    assert got["coverage"].count() == 16
    with pytest.raises(ValueError):
        reports.compare(spark, "", "", mode="other")


def test_solve(spark, dump, tmp_path):
    (tmp_path / "p.maps").write_text("10-4f r-xp 0 08:01 1 /bin/p\n")
    table = spark.createDataFrame([(16, "main", "m.c")], "address long, name string, file string")
    got = {r["address"]: (r["name"], r["image"]) for r in reports.solve(spark, str(dump / "cct"), str(tmp_path / "p.maps"), table).collect()}
    assert got[16] == ("main", "/bin/p") and got[160] == ("UNKNOWN", "UNKNOWN") and got[0][0] == "<dummy>"


def test_a_resolver_is_asked_for_the_rest(spark, dump, tmp_path):
    (tmp_path / "p.maps").write_text("10-1f r-xp 0 08:01 1 /bin/p\n20-4f r-xp 4 08:01 1 /lib/q\n")
    table = spark.createDataFrame([(16, "main", "m.c")], "address long, name string, file string")
    resolver = lambda image, offsets: [(f"{image}+{o}", "x.c") for o in offsets]
    found = reports.solve(spark, str(dump / "cct"), str(tmp_path / "p.maps"), table, resolver)
    got = {r["address"]: (r["name"], r["image"], r["offset"]) for r in found.collect()}
    assert got[16][0] == "main" and got[32] == ("/lib/q+4", "/lib/q", 4) and got[64] == ("/lib/q+36", "/lib/q", 36) and got[160][0] == "UNKNOWN"
    tool = tmp_path / "tool"
    tool.write_text('#!/bin/sh\nshift 3\nfor a in "$@"; do echo "f$a"; echo "src/a.c:12"; done\n')
    tool.chmod(0o755)
    assert symbols.addr2line("/bin/p", [16, 32], str(tool)) == [("f0x10", "src/a.c"), ("f0x20", "src/a.c")]


def test_run_report(spark):
    row = reports.run_report(spark.range(1000), 1000).first()
    assert row["seconds"] > 0 and abs(row["us_per_event"] - row["seconds"] * 1000) < 1e-6 and row["peak_kb"] > 0


def test_errors_of_sketched_counters(spark):
    exact = spark.createDataFrame([("a", 10), ("b", 4), ("c", 1)], "path string, counter long")
    other = spark.createDataFrame([("a", 12, True, 2), ("b", 5, True, 0), ("c", 9, False, 0), ("z", 1, True, 0)], "path string, counter long, monitored boolean, eps long")
    plain, less = (metrics.counter_error(exact, other, 2, less_eps=x).first() for x in (False, True))
    assert (plain["hot"], plain["max_error"], plain["avg_error"]) == (2, 25.0, 22.5) and (less["max_error"], less["avg_error"]) == (25.0, 12.5)
    assert metrics.missing_exact(exact, other) == 1 and metrics.missing_exact(exact, exact) == 0


def test_burst_report(spark):
    rows = spark.createDataFrame([(5,), (25,)], "tick long")
    sampled = spark.createDataFrame([(True,)], "burst_start boolean")
    got = sampling.burst_report(rows, sampled, BurstParams(50, 10), 200).first().asDict()
    assert got == {"enters": 2, "sampled": 1, "bursts": 1, "percent": 50.0, "run_us": 4000, "sampling_us": 10_000, "burst_us": 2000}


def test_bad_dump(spark, tmp_path):
    (tmp_path / "x").write_text("c cct \nc prog 3 /tmp\nv 1 0 1 0 0\nv 2 9 5 a b\np 2 5\n")
    with pytest.raises(dumps.BadDump):
        reports.load(spark, str(tmp_path / "x"))
