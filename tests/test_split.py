"""Arrays read in blocks give the elements that a JSON parser finds."""

import json

import pytest
from pyspark.sql import functions as F

from parlance.sources import export, split

TRICKY = [
    {"a": 'x},{"b":[1,2],"', "b": ["}", "[", "\\", '\\"', '"}']},
    {"role": "user", "content": "é🙂 }{][ \\\\"},
    [1, [2, {"c": "]"}]],
    5,
    None,
    "plain, } text",
    {},
    {"long": "y}" * 3000},
    {"text": "z" * 5000},
    {"deep": [[[[{"d": {"e": [1, "}"]}}]]]]},
]


def _elements(spark, path):
    rows, other = split.read_elements(spark, path)
    return sorted(json.dumps(json.loads(r["raw"]), sort_keys=True) for r in rows.collect()), other


@pytest.mark.parametrize("block", ["301b", "4k"])
def test_elements_at_any_block_size(spark, tmp_path, block):
    (tmp_path / "a.json").write_text("﻿ junk " + json.dumps(TRICKY * 3, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps(TRICKY, indent=2))
    (tmp_path / "c.json").write_text("[]")
    (tmp_path / "d.json").write_text('{"messages": [{"role": "user", "content": "one"}]}')
    (tmp_path / "e.json").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "16b")
    try:
        got, other = _elements(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted(json.dumps(x, sort_keys=True) for x in TRICKY * 4)
    assert [o.rpartition("/")[2] for o in other] == ["d.json"]


def test_broken_end_is_left_out(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1}, {"b": 2}, {"c": 3')
    assert _elements(spark, str(tmp_path))[0] == ['{"a": 1}', '{"b": 2}']


def test_large_reader_agrees_with_the_plain_one(spark, tmp_path):
    convs = [{"create_time": 1_700_000_000 + i, "messages": [{"role": "user", "content": f"q {i} }}"}, {"role": "assistant", "content": "a" * i}]} for i in range(300)]
    (tmp_path / "a.json").write_text(json.dumps(convs))
    (tmp_path / "b.json").write_text(json.dumps(convs[0]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        large = export.normalize(export.read_large(spark, str(tmp_path))).drop("conv_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    plain = export.normalize(export.read_conversations(spark, str(tmp_path))).drop("conv_id").collect()
    assert sorted(map(str, large)) == sorted(map(str, plain)) and len(plain) == 602
    ids = export.read_large(spark, str(tmp_path)).select(F.count_distinct("conv_id")).first()[0]
    assert ids == 301
