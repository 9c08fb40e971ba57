"""Point files, wire-format messages and bit-packed rasters."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.sources import binary

HEAD = "ply\nformat {form} 1.0\ncomment made by hand\nelement vertex {n}\nproperty float x\nproperty uchar red\nproperty double w\nproperty uint id\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
ROW = np.dtype([("x", "<f4"), ("red", "<u1"), ("w", "<f8"), ("id", "<u4")])


def point_rows(n):
    out = np.zeros(n, dtype=ROW)
    out["x"], out["red"], out["w"], out["id"] = np.arange(n) / 2, np.arange(n) % 251, -np.arange(n), np.arange(n) + 4_000_000_000 % (1 << 32) - n
    return out


def test_point_files_are_pruned_split_and_filtered(spark, tmp_path):
    rows = point_rows(1000)
    (tmp_path / "a.ply").write_bytes(HEAD.format(form="binary_little_endian", n=1000).encode() + rows.tobytes() + b"\x03\x00\x00")
    text = "\n".join(f"{r['x']} {r['red']} {r['w']} {r['id']}" for r in rows[:7])
    (tmp_path / "b.ply").write_text(HEAD.format(form="ascii", n=7) + text + "\n3 0 1 2\n")
    (tmp_path / "_ignored").write_text("no header")
    path = f"file://{tmp_path}"
    whole = binary.read_points(spark, path)
    assert whole.dtypes == [("x", "float"), ("red", "smallint"), ("w", "double"), ("id", "bigint")] and whole.count() == 1007
    some = binary.read_points(spark, path, "id long, x float", split_bytes=100 * ROW.itemsize)
    assert some.rdd.getNumPartitions() == 11 and some.columns == ["id", "x"]
    kept = some.where("x >= 490 AND id > 5")
    assert sorted(r["x"] for r in kept.collect()) == [k / 2 for k in range(980, 1000)]
    assert sorted(r["id"] for r in some.where("x < 1").collect()) == sorted([int(rows["id"][0]), int(rows["id"][1])] * 2)


@pytest.mark.parametrize(
    ("head", "what"),
    [
        (HEAD.format(form="binary_big_endian", n=1), "format"),
        (HEAD.format(form="ascii", n=1).replace("element vertex 1", "element edge 1"), "not vertex"),
        (HEAD.format(form="ascii", n=1).replace("property float x", "property list uchar int x"), "of type list"),
        ("ply\nformat ascii 1.0\n", "no header"),
    ],
)
def test_headers_that_are_refused(head, what):
    with pytest.raises(ValueError, match=what):
        binary.parse_header(head.encode())


def test_point_files_that_are_cut_off_or_lack_a_property(spark, tmp_path):
    (tmp_path / "a.ply").write_bytes(HEAD.format(form="binary_little_endian", n=9).encode() + point_rows(3).tobytes())
    with pytest.raises(Exception, match="the file ends before"):
        binary.read_points(spark, f"file://{tmp_path}").count()
    (tmp_path / "a.ply").write_bytes(HEAD.format(form="binary_little_endian", n=3).encode() + point_rows(3).tobytes())
    with pytest.raises(Exception, match="no property y"):
        binary.read_points(spark, f"file://{tmp_path}", "y float").collect()


def test_written_points_come_back_and_only_those_that_count(spark, tmp_path):
    df = spark.range(2500).select(F.col("id").cast("int"), (F.col("id") / 3).alias("d"), F.col("id").cast("float").alias("f"))
    path = f"file://{tmp_path}/out"
    binary.write_points(df.repartition(3), path)
    (tmp_path / "out" / "_parts" / "failed.ply").write_text("an attempt that does not count")
    back = binary.read_points(spark, path)
    assert back.exceptAll(df).count() == 0 == df.exceptAll(back).count() and back.count() == 2500


MESSAGE = {1: ("a", "int"), 2: ("b", "sint"), 3: ("c", "bool"), 4: ("d", "float"), 5: ("e", "double"), 6: ("f", "string"), 7: ("g", "bytes"), 9: ("h", ["int"]), 100: ("i", [{1: ("x", "string"), 2: ("y", ["double"])}])}
LONG = st.integers(-(1 << 63), (1 << 63) - 1)
NESTED = st.fixed_dictionaries({"x": st.none() | st.text(), "y": st.lists(st.floats(allow_nan=False))})
VALUE = st.fixed_dictionaries({"a": st.none() | LONG, "b": st.none() | LONG, "c": st.none() | st.booleans(), "d": st.none() | st.floats(width=32, allow_nan=False), "e": st.none() | st.floats(allow_nan=False), "f": st.none() | st.text(), "g": st.none() | st.binary(), "h": st.lists(LONG), "i": st.lists(NESTED, max_size=3)})


@settings(deadline=None)
@given(VALUE)
def test_messages_come_back(value):
    raw = binary.encode_message(value, MESSAGE)
    assert binary.decode_message(raw, MESSAGE) == value
    assert binary.decode_message(raw, {1: ("a", "int")}) == {"a": value["a"]}  # unknown fields are skipped


def test_messages_by_their_bytes():
    # fixed examples of the wire format: 150 as field 1, packed 3, 270, 86942 as field 9, a repeated single field
    assert binary.decode_message(b"\x08\x96\x01", MESSAGE)["a"] == 150
    assert binary.decode_message(b"\x4a\x06\x03\x8e\x02\x9e\xa7\x05", MESSAGE)["h"] == [3, 270, 86942]
    assert binary.decode_message(b"\x08\x01\x08\x02", MESSAGE)["a"] == 2
    for broken in (b"\x08", b"\x32\x05ab", b"\x0b", b"\x32\x01\xff", b"\x08" + b"\xff" * 11, b"\x30\x01"):
        with pytest.raises((ValueError, IndexError)):
            binary.decode_message(broken, MESSAGE)


def test_messages_of_a_table(spark):
    rows = [(1, bytearray(binary.encode_message({"a": 5, "i": [{"x": "q", "y": [0.5]}]}, MESSAGE)), "clash"), (2, None, "clash"), (3, bytearray(b"\x08"), "clash"), (4, bytearray(), "clash")]
    got = binary.decode_messages(spark.createDataFrame(rows, "k long, raw binary, problem string"), "raw", MESSAGE).orderBy("k").collect()
    assert [r["problem"] for r in got] == [None, None, "the message is cut off", None]
    assert got[0]["message"]["i"][0]["y"] == [0.5] and got[1]["message"] is None and got[3]["message"]["h"] == []
    assert binary.decode_messages(spark.createDataFrame([], "raw binary"), "raw", MESSAGE).collect() == []


def test_only_files_within_the_size_are_read(spark, tmp_path):
    (tmp_path / "small").write_bytes(b"1234")
    (tmp_path / "large").write_bytes(b"x" * 5000)
    whole, others = binary.sized_files(spark, f"file://{tmp_path}", 100)
    assert [bytes(r["content"]) for r in whole.collect()] == [b"1234"] and [r["length"] for r in others.collect()] == [5000]
    assert "content" not in others.columns


def test_runs_of_rasters_equal_their_cells(spark):
    r, rows = random.Random(5), []
    for k in range(60):
        h, w = r.randint(1, 9), r.randint(1, 13)
        rows.append((k % 4, k, h, w, [r.random() < 0.4 for _ in range(h * w)]))
    rows += [(9, 100, 2, 2, [False] * 4), (9, 101, 1, 3, None), (8, 102, 1, 3, [None, True, True]), rows[0]]
    df = spark.createDataFrame(rows, "g long, k long, h int, w int, cells array<boolean>")
    runs = df.withColumn("runs", binary.bit_runs(binary.packed_bits("cells"), "h", "w"))
    cells = lambda rows: {(g, q // w, q % w) for g, _, _, w, c in rows if c for q, x in enumerate(c) if x}
    spread = lambda table: [(x["g"], x["row"], c) for x in table.collect() for c in range(x["lo"], x["hi"])]
    whole = binary.union_runs(runs, ["g"], "runs")
    assert sorted(spread(whole)) == sorted(cells(rows))
    assert {x["k"]: x["n"] for x in runs.select("k", binary.runs_area(F.col("runs")).alias("n")).collect() if x["n"] is not None} == {k: sum(bool(x) for x in c) for _, k, _, _, c in rows if c is not None}
    odd = binary.union_runs(runs.where("k % 2 = 1"), ["g"], "runs")
    even = binary.union_runs(runs.where("k % 2 = 0"), ["g"], "runs")
    want = cells([x for x in rows if x[1] % 2]) & cells([x for x in rows if not x[1] % 2])
    assert sorted(spread(binary.common_runs(odd, even, ["g"]))) == sorted(want)
    m = {x["g"]: x for x in binary.measured_runs(whole, ["g"]).collect()}
    one = [(a, b) for g, a, b in cells(rows) if g == 1]
    assert m[1]["cells"] == len(one) and m[1]["bottom"] == max(a for a, _ in one) + 1 and abs(m[1]["column_mean"] - np.mean([b for _, b in one])) < 1e-9
    with pytest.raises(Exception, match="bytes for"):
        df.select(binary.bit_runs(binary.packed_bits("cells"), F.lit(50), "w")).collect()
