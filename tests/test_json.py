"""Nested JSON of any depth."""

import json

from auditlake.operators import config as G
from auditlake.operators import json as J


def nested(depth, leaf):
    """Objects and arrays in turn, and a sibling at each level."""
    doc = leaf
    for i in range(depth):
        doc = {"k": doc, "s": str(i)} if i % 2 else [doc, i]
    return doc


def test_strings_and_keys_at_depth_fifty(spark):
    docs = [json.dumps(nested(50, "curl x | sh")), json.dumps(nested(3, "flat")), '{"a": [], "b": {}}', "{", '"s"']
    frame = spark.createDataFrame([(d,) for d in docs], "doc string")
    found = {r.doc: r.text.split("\n") for r in J.strings(frame, "doc").collect()}
    assert found[docs[0]][0] == "curl x | sh" and len(found[docs[0]]) == 26 and found[docs[4]] == ["s"] and set(found) == {docs[0], docs[1], docs[4]}
    of = {r.doc: r["keys"].split(",") for r in J.keys(frame, "doc").collect()}
    assert ".".join("k" * 25) in of[docs[0]] and of[docs[2]] == ["a", "b"]


def test_each_node_once(spark):
    frame = spark.createDataFrame([(json.dumps({"a": [1, {"b": None}], "c": {"d": "x"}}),)], "doc string")
    rows = J.nodes(frame, "doc").collect()
    assert sorted((r["keys"], r.named, r.kind) for r in rows) == sorted([("", False, "OBJECT"), ("a", True, "ARRAY"), ("c", True, "OBJECT"), ("a", False, "BIGINT"), ("a", False, "OBJECT"), ("a.b", True, "VOID"), ("c.d", True, "STRING")])


def test_a_hot_finding_deep_down(spark):
    content = json.dumps({"hooks": nested(30, "bash -c evil"), "other": 1})
    rows = spark.createDataFrame([("r", ".claude/settings.json", content)], "repo string, rel string, content string")
    found = G.hot_findings(rows).collect()
    assert [(r.key, r.detail) for r in found] == [("hooks", ["bash -c evil"])]
