"""Registered queries against their SQL, and the streaming forms against the batch ones."""

from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from stackgrove.operators import contexts, sketches, trees
from stackgrove.plans import queries, sql
from stackgrove.sources.events import SCHEMA, from_event_log, read_event_log
from stackgrove.streaming import live

DATA = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(sql.ORACLE))
def test_query_equals_sql(spark, duck, name):
    got = queries.queries()[name](spark, DATA).toPandas()
    want = duck.execute(sql.ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    as_rows = lambda df: sorted(map(tuple, df[columns].astype(str).values.tolist()))
    assert as_rows(got) == as_rows(want)


def test_every_sql_has_its_query():
    assert set(sql.ORACLE) <= set(queries.queries())


def last_snapshots(spark, tmp_path, run, name):
    """What the stream over two halves of the log gave last of each thread: rows by (tid, path)."""
    log = spark.read.parquet(f"{DATA}/events.parquet").orderBy("ts", "event_id")
    half = log.approxQuantile("event_id", [0.5], 0)[0]
    for k, part in enumerate((log.filter(F.col("event_id") <= half), log.filter(F.col("event_id") > half))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    schema = spark.read.parquet(f"{DATA}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    batches = []
    query = run(from_event_log(stream)).writeStream.outputMode("update").foreachBatch(lambda df, _: batches.append(df.collect())).queryName(name).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return batches


def test_streamed_contexts_equal_batch(spark, tmp_path):
    got = {}
    for batch in last_snapshots(spark, tmp_path, live.exact_snapshots, "exact"):
        got |= {(r["tid"], r["path"]): r["counter"] for r in batch}
    want = {(r["tid"], r["path"]): r["counter"] for r in trees.exact_tree(contexts.enters(read_event_log(spark, DATA)), by_thread=True).collect()}
    assert got == want


def test_streamed_sketches_equal_batch(spark, tmp_path):
    got = {}
    for batch in last_snapshots(spark, tmp_path, lambda events: live.sketch_snapshots(events, "lss", 8), "lss"):
        for tid in {r["tid"] for r in batch}:  # a snapshot is the whole sketch of its thread
            got[tid] = {(r["path"], r["counter"], r["monitored"]) for r in batch if r["tid"] == tid}
    want = {}
    for r in sketches.sketch(contexts.enters(read_event_log(spark, DATA)), "lss", 8).collect():
        want.setdefault(r["tid"], set()).add((r["path"], r["counter"], r["monitored"]))
    assert {t: rows for t, rows in got.items() if rows} == want


def test_sliding_and_session_windows(spark):
    at = lambda minute: datetime(2024, 1, 1, 0, minute)
    rows = [("t", 1, i, "ENTER", "a", 0, at(m), 0) for i, m in enumerate((1, 6, 30))]
    events = spark.createDataFrame(rows, SCHEMA)
    sliding = {(r["start"], r["enters"]) for r in live.windowed_calls(events, "10 minutes", "1 hour", "5 minutes").collect()}
    assert sliding == {(datetime(2023, 12, 31, 23, 55), 1), (at(0), 2), (at(5), 1), (at(25), 1), (at(30), 1)}
    sessions = {(r["start"], r["end"], r["enters"]) for r in live.windowed_calls(events, "10 minutes", "1 hour", session=True).collect()}
    assert sessions == {(at(1), at(16), 2), (at(30), at(40), 1)}
