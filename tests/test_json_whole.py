"""JSON trees nest down to the leaves."""

from stackgrove.plans import queries
from stackgrove.sinks import texts

DATA = "/root/testdata/sf0.001"


def test_json_of_whole_trees(spark):
    kids: dict[str, list[str]] = {}
    for r in queries.exact_cct(spark, DATA).collect():
        kids.setdefault(r["path"].rpartition("/")[0], []).append(r["path"])

    def nested(path):
        inner = ",".join(sorted(nested(k) for k in kids.get(path, [])))
        return '{"name":"' + path.rpartition("/")[2] + '","children":[' + inner + "]}"

    rows = queries.json_tree(spark, DATA).collect()
    assert sorted((r["name"], r["json"]) for r in rows) == sorted((k, nested(k)) for k in kids[""])
    assert sum(r["json"].count('{"name"') for r in rows) == sum(map(len, kids.values()))


def test_json_of_no_nodes(spark):
    assert texts.json_tree(spark.createDataFrame([], "path string, depth int, counter long")).count() == 0
