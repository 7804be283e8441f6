"""Members of an index stay in Spark."""

from __future__ import annotations

import json

from rankwell.sources import files


def test_leaves_refer_to_a_table(spark, tmp_path):
    doc = {"children": [{"children": ["a", "b"]}, {"children": [{"children": ["c"]}, {"children": []}]}]}
    nodes, members = files.import_index(spark, doc)
    out = files.export_index(nodes, members, f"file://{tmp_path}/members")
    assert '"c"' not in json.dumps(out)  # no id comes to the driver
    again, held = files.import_index(spark, out)
    assert sorted(map(str, again.collect())) == sorted(map(str, nodes.collect()))
    assert sorted(map(tuple, held.collect())) == sorted(map(tuple, members.collect()))


def test_csv_leaf_stays_in_spark(spark, tmp_path, monkeypatch):
    (tmp_path / "leaf.csv").write_text("id,x\nq,1\nr,2\np,3\n")
    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", None)
    nodes, members = files.import_index(spark, {"children": [{"children": str(tmp_path / "leaf.csv")}, {"children": ["z"]}]})
    assert sorted(tuple(r) for r in members.collect()) == [(1, "p", 2), (1, "q", 0), (1, "r", 1), (2, "z", 0)]
    assert {r.node_id: r["size"] for r in nodes.collect()} == {0: 0, 1: 3, 2: 1}
