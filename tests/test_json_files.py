"""Large JSON files in parts give the items that a whole read gives, wherever the parts end."""

import json
import random

import pytest

from larder.sources.json_files import json_documents
from larder.sources.readers import json_entries, json_items

ODD = ['}{', '"', "\\", '\\"', "},{", '"packages":[', "é漢😀", "\n", "x" * 3000, ""]


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind < 3:
        return rng.choice(ODD) + rng.choice(ODD)
    if kind == 3:
        return rng.choice([1, -2.5e3, True, None])
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(ODD[:7]) + str(k): value(rng, depth + 1) for k in range(rng.randrange(4))}


def same(read, wanted):
    return sorted(json.dumps(x, sort_keys=True) for x in read) == sorted(json.dumps(x, sort_keys=True) for x in wanted)


def found(documents, at):
    items = []
    for r in documents.collect():
        whole = json.loads(r["value"])
        part = whole if at is None else whole[at]
        items += list(part.items()) if isinstance(part, dict) else part
    return [list(x) if isinstance(x, tuple) else x for x in items]


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("at", [None, "packages"])
@pytest.mark.parametrize("entries", [False, True])
def test_parts_give_all_items(spark, tmp_path, indent, at, entries):
    rng = random.Random(f"{indent} {at} {entries}")
    wanted = []
    for n in range(2):
        items = {f"{k}-{n}": value(rng) for k in range(40)} if entries else [value(rng) for _ in range(40)]
        wanted += [list(x) for x in items.items()] if entries else items
        beside = {"packages": [{"packages": [{"no": 1}]}]}
        whole = items if at is None else {"before": [beside, "packages"], at: items, "after": {"a": {"b": beside}, "packages": {"c": 1}}}
        (tmp_path / f"{n}.json").write_text(json.dumps(whole, indent=indent, ensure_ascii=n == 0), encoding="utf-8-sig" if n == 1 else "utf-8")
    for part in (1_500, 1 << 25):
        assert same(found(json_documents(spark, str(tmp_path), at, 2_000, part), at), wanted), part


def test_parts_do_not_hang_on_the_session(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"a": k} for k in range(2_000)]))
    documents = json_documents(spark, str(tmp_path), None, 500, 4_000)
    tasks = documents.rdd.getNumPartitions()
    before = spark.conf.get("spark.sql.files.minPartitionNum", None)
    spark.conf.set("spark.sql.files.minPartitionNum", "50")
    try:
        assert same([r["item"]["a"] for r in json_items(documents, "struct<a:int>").collect()], range(2_000))
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum") if before is None else spark.conf.set("spark.sql.files.minPartitionNum", before)
    assert tasks > 4


def test_readers_take_the_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"repository": {f"r{k}": {"v": k} for k in range(500)}}))
    rows = json_entries(json_documents(spark, str(tmp_path), "repository", 300, 900), "struct<v:int>", "repository")
    assert {r["key"]: r["item"]["v"] for r in rows.collect()} == {f"r{k}": k for k in range(500)}


@pytest.mark.parametrize("text", ["", "[]", "{}", " [ ] \n", '{"packages": {}}', '{"packages": null, "x": [{"a": 1}]}', "12"])
def test_nothing_to_read(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    assert json_documents(spark, str(tmp_path), "packages").count() == 0


@pytest.mark.parametrize("text", ['[{"a": 1}, ', '[{"a": 1}', '{"a": {"x": 1}, ', '[{"a": "x}]', '[{"a": 1}]]'])
def test_torn_file_is_an_error(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="not a whole JSON text"):
        json_documents(spark, str(tmp_path))


def test_key_with_a_brace(spark, tmp_path):
    with pytest.raises(ValueError):
        json_documents(spark, str(tmp_path), "a}b")
    (tmp_path / "a.json").write_text(json.dumps({"x}packages": [1], "packages": [2]}))
    assert found(json_documents(spark, str(tmp_path), "packages", 10, 1), "packages") == [2]
