"""Children of every pair of one path are compared, at any depth."""

from stackgrove.plans import queries

DATA = "/root/testdata/sf0.001"


def test_all_children_of_same_paths_are_compared(spark):
    kids: list[dict] = [{}, {}]
    paths = [[r["path"] for r in q(spark, DATA).collect()] for q in (queries.exact_cct, queries.static_burst_walk)]
    for side, found in zip(kids, paths, strict=True):
        for path in found:
            side.setdefault(path.rpartition("/")[0], []).append(path)
    same = (set(paths[0]) & set(paths[1])) | {""}
    want = {(a, b) for p in same for a in kids[0].get(p, []) for b in kids[1].get(p, [])}
    rows = queries.child_similarity(spark, DATA).collect()
    assert len(rows) == len(want) and {(r["first_path"], r["second_path"]) for r in rows} == want
    assert max(a.count("/") for a, _ in want) >= 2
