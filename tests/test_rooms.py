"""Room documents as tables."""

from __future__ import annotations

from tessera.sources.rooms import room_tables


def test_documents_become_tables_or_refusals(spark):
    whole = '{"schema": "s", "room": {"height": 2.5, "walls": [{"id": "w", "a": [0, 1], "b": [2, 3], "normal": [0, 1]}], "openings": [{"id": "p1", "kind": "door", "wall": "w", "u0": 0, "u1": 1, "v0": 0, "v1": 2}]}, "objects": [{"id": "p1", "size": [1, 2, 3], "center": [0, 1, 0], "confidence": {"size_from": "Measured, held"}}, {"id": "p2", "size": [1], "center": []}], "lights": [{"id": "l", "position": [1, 2, 3]}]}'
    rows = [(1, whole), (2, '{"schema": "t"}'), (3, "{"), (4, None), (5, '{"schema": "s"}'), (6, "")]
    t = {k: sorted(tuple(r) for r in v.collect()) for k, v in room_tables(spark.createDataFrame(rows, "k int, text string"), "k", "text", "s").items()}
    assert t["walls"] == [(1, "w", 0.0, 1.0, 2.0, 3.0, 0.0, 1.0)] and t["openings"] == [(1, "p1", "door", "w", 0.0, 1.0, 0.0, 2.0, 0.0, False)]
    assert t["lights"] == [(1, "l", None, 1.0, 2.0, 3.0, "", False)] and [r[0] for r in t["rooms"]] == [1, 5]
    assert [(r[1], r[4], r[10], r[13], r[14], r[15]) if len(r) > 15 else r for r in t["pieces"]] == [("p1", "floor", 0.0, 0.0, 0.04, "p1"), ("p2", "floor", None, 0.0, 0.06, None)]
    assert t["refused"] == [(2, "other_schema"), (3, "not_json"), (4, "not_json"), (6, "not_json")]
