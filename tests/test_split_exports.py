"""Exports that several tasks read in parts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from veilspark.sources import exports, split_exports


@pytest.fixture
def small_ranges(spark):
    """Ranges of a few hundred bytes, as if files were large."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in zip(names, ("300", "1", "1")):
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def odd_conversations(n):
    rng = random.Random(5)
    nasty = ['a "quoted" } brace', "back\\slash", 'ends with \\"', "{[,]}", "é漢😀\n\t", "}", "\\\\", '"', "", "plain words here " * 30]
    turn = lambda i: {"uuid": f"m{i}", "sender": "human", "text": rng.choice(nasty) + str(i), "content": [{"type": "text", "text": rng.choice(nasty)}], "created_at": "2024-01-01T00:00:00Z"}
    return [{"uuid": f"c{c}", "chat_messages": [turn(c * 100 + i) for i in range(rng.randrange(6))], "note": {"x": [1, {"y": "}{"}]}} for c in range(n)]


def test_elements_equal_the_whole_array(spark, tmp_path, small_ranges):
    files = {"a.json": odd_conversations(40), "b.json": [], "c.json": [None, {"uuid": "z", "chat_messages": []}, 3, [{"k": "}"}], "},{", {"uuid": "y"}]}
    for name, value in files.items():
        (tmp_path / name).write_text(json.dumps(value, ensure_ascii=name == "c.json", indent=1 if name == "c.json" else None), encoding="utf-8")
    got = {}
    found = split_exports.elements(spark, str(tmp_path))
    for r in found.collect():
        assert got.setdefault((r["file"].rsplit("/", 1)[1], r["row"]), json.loads(r["content"])) is not None
    assert got == {(name, i): v for name, vs in files.items() for i, v in enumerate(vs) if isinstance(v, (dict, list))}
    ranges = split_exports._ranges(split_exports._records(spark, str(tmp_path), "*.json"))
    assert ranges.where(F.col("file").endswith("a.json")).count() > 20


def test_messages_equal_those_of_whole_files(spark, tmp_path, small_ranges):
    (tmp_path / "a.json").write_text(json.dumps(odd_conversations(30)), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps({"conversations": odd_conversations(3)}), encoding="utf-8")
    whole = exports.parse_exports(exports.read_exports(spark, str(tmp_path))).collect()
    parts = exports.messages_of(split_exports.read_all(spark, str(tmp_path))).collect()
    assert sorted(map(str, whole)) == sorted(map(str, parts)) and len(whole) > 50
