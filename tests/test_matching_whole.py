"""Matching over whole trees: nothing below a fixed depth is left out."""

import pytest

from stackgrove.plans import queries
from stackgrove.scratch import Scratch

DATA = "/root/testdata/sf0.001"


def parent(path):
    return path.rpartition("/")[0]


@pytest.fixture(scope="module")
def tree(spark):
    return {r["path"]: r["counter"] for r in queries.exact_cct(spark, DATA).collect()}


@pytest.fixture(scope="module")
def burst(spark):
    return {r["path"]: r["counter"] for r in queries.static_burst_walk(spark, DATA).collect()}


def test_match_queries_reach_every_node(spark, tree, burst, monkeypatch):
    matches = Scratch(spark, "t").table(queries.match_trees(spark, DATA), "matches")
    monkeypatch.setattr(queries, "match_trees", lambda *_: matches)  # matched once for all three
    rows = matches.collect()
    pairs = {r["first_path"]: r["second_path"] for r in rows}
    assert len(rows) == len(pairs) and set(pairs) == set(tree) | {""}
    matched = {a: b for a, b in pairs.items() if b is not None}
    assert len(set(matched.values())) == len(matched) and set(matched.values()) <= set(burst) | {""}
    assert all(matched[parent(a)] == parent(b) for a, b in matched.items() if a)
    assert max(a.count("/") for a in matched) >= 3  # depth 4 and more
    lost = [tree[a] for a, b in pairs.items() if b is None]
    got = queries.unmatched_frequency(spark, DATA).first()
    assert (got["unmatched"], got["max"]) == (len(lost), max(lost)) and got["avg"] == pytest.approx(sum(lost) / len(lost))
    summary = queries.match_summary(spark, DATA).first()
    assert (summary["matched"], summary["first_unmatched"], summary["second_unmatched"]) == (len(matched), len(lost), len(burst) + 1 - len(matched))
