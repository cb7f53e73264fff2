"""CBOR items and files."""

import math
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trackloom.sources import cbor, layout

LEAF = st.one_of(st.none(), st.booleans(), st.integers(-(2**64), 2**64 - 1), st.floats(allow_nan=False), st.binary(max_size=40), st.text(max_size=40))
ITEM = st.recursive(LEAF, lambda inner: st.lists(inner, max_size=5) | st.dictionaries(st.text(max_size=8) | st.sampled_from(["$bytes", "$float", "$$x"]), inner, max_size=5), max_leaves=20)


@settings(max_examples=200, deadline=None)
@given(ITEM)
def test_items_round_trip(item):
    raw = cbor.encoded(item)
    assert cbor.decoded(raw) == item
    assert cbor.from_json(cbor.as_json(raw)) == raw


@settings(max_examples=200, deadline=None)
@given(ITEM, st.data())
def test_what_is_cut_short_is_an_error(item, data):
    raw = cbor.encoded(item)
    cut = data.draw(st.integers(0, len(raw) - 1))
    with pytest.raises(ValueError):
        cbor.decoded(raw[:cut])
    with pytest.raises(ValueError):
        cbor.decoded(raw + b"\x00")


# examples of the public specification's appendix
@pytest.mark.parametrize(
    ("item", "raw"),
    [(0, "00"), (23, "17"), (24, "1818"), (1000, "1903e8"), (1000000, "1a000f4240"), (2**64 - 1, "1bffffffffffffffff"), (-1, "20"), (-1000, "3903e7"), (100000.0, "fa47c35000"), (1.1, "fb3ff199999999999a"), (1.0e300, "fb7e37e43c8800759c"), (math.inf, "fa7f800000"), (False, "f4"), (None, "f6"), (b"\x01\x02\x03\x04", "4401020304"), ("\u00fc", "62c3bc"), ([1, [2, 3], [4, 5]], "8301820203820405"), ({"a": 1, "b": [2, 3]}, "a26161016162820203")],
)
def test_known_bytes(item, raw):
    assert cbor.encoded(item).hex() == raw and cbor.decoded(bytes.fromhex(raw)) == item


def test_what_is_only_read():
    assert cbor.decoded(bytes.fromhex("f93c00")) == 1.0 and cbor.decoded(bytes.fromhex("c11a514b67b0")) == 1363896240
    assert cbor.encoded(math.nan)[:1] == b"\xfa" and math.isnan(cbor.decoded(cbor.encoded(math.nan)))
    for raw in ("9f01ff", "f8ff", "a10102", "1c", "81" * 1000 + "00", "62ff"):
        with pytest.raises(ValueError):
            cbor.decoded(bytes.fromhex(raw))


def test_project_files_round_trip(spark, tmp_path):
    cbor.register(spark)
    scripts = layout.encode_project([layout.encode_script([(0.5, 10), (1.25, 90)], "a.funscript", "a"), layout.encode_script([], "b", "")])
    items = [(f"deep/{n}.ofsp", cbor.as_json(cbor.encoded({"title": f"t{n}", "n": n, "pi": 3.25, "tags": ["x", {"$odd": None}], "data": scripts}))) for n in range(70)]
    spark.createDataFrame(items, "path string, item string").repartition(3).write.format("cbor").mode("append").save(str(tmp_path))
    (tmp_path / "bad.ofsp").write_bytes(struct.pack(">BH", 0x99, 5))
    (tmp_path / "notes.txt").write_bytes(b"no item")
    read = spark.read.format("cbor").option("suffix", ".ofsp").option("files_per_task", 8).load(str(tmp_path))
    assert read.rdd.getNumPartitions() == 9
    bad = read.where("error is not null").collect()
    assert [(r.path.rsplit("/", 1)[1], r.item) for r in bad] == [("bad.ofsp", None)]
    variant = F.parse_json("item")
    got = read.where("error is null").select(F.substring_index("path", "/", -1).alias("name"), F.variant_get(variant, "$.n", "int").alias("n"), F.variant_get(variant, "$.tags[1].$$odd", "string").alias("odd"), F.unbase64(F.get_json_object("item", "$.data.$bytes")).alias("data")).collect()
    assert sorted((r.name, r.n) for r in got) == sorted((f"{n}.ofsp", n) for n in range(70))
    assert all(bytes(r.data) == scripts and [layout.decode_script(s)[1] for s in layout.decode_project(bytes(r.data))] == ["a.funscript", "b"] for r in got)
    one = spark.read.format("cbor").load(f"{tmp_path}/deep/7.ofsp").first()
    assert cbor.from_json(one.item) == cbor.from_json(items[7][1])
    with pytest.raises(Exception, match="no path within"):
        spark.createDataFrame([("../out", "1")], "path string, item string").write.format("cbor").mode("append").save(str(tmp_path))
