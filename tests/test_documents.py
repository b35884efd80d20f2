"""JSON arrays by ranges of bytes, against the json module, at any size of a range."""

import json
import random

import pytest

from tallyforge.sources import documents, readers


@pytest.fixture
def ranges(spark):
    def of(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")

    yield of
    for k in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{k}")


def value(r, depth=0):
    kind = r.randrange(9 if depth < 4 else 5)
    if kind < 2:
        return "".join(r.choice('ab{}[]",:\\\n ünï🙂') for _ in range(r.randrange(12)))
    if kind < 5:
        return r.choice([None, True, -1.5, 7, 10**20, "", "}", '\\"', "\\\\"])
    if kind < 7:
        return {str(value(r, 9)): value(r, depth + 1) for _ in range(r.randrange(4))}
    return [value(r, depth + 1) for _ in range(r.randrange(4))]


def key(x):
    return json.dumps(x, sort_keys=True)


@pytest.mark.parametrize("seed", range(4))
def test_elements_of_random_documents(spark, tmp_path, ranges, seed):
    r = random.Random(seed)
    want = {}
    for k in range(4):
        doc = [value(r) for _ in range(r.randrange(40))] if k else {"only": [value(r) for _ in range(20)], "x": {"y": "}"}}
        text = json.dumps(doc, ensure_ascii=bool(k % 2), indent=r.choice([None, 1])) + r.choice(["", "\n", "  "])
        (tmp_path / f"{k}.json").write_text(text, encoding="utf-8")
        want[k] = sorted(key(x) for x in (doc if isinstance(doc, list) else [doc]) if isinstance(x, dict | list))
    (tmp_path / "8.json").write_text("")
    (tmp_path / "9.json").write_text(" [ ]\n")
    for size in (7, 60, 1000, 1 << 20):
        ranges(size)
        got = {k: [] for k in want}
        for row in documents.elements(spark, str(tmp_path)).collect():
            got[int(row.path[-6])].append(key(json.loads(row.value)))
        assert {k: sorted(v) for k, v in got.items()} == want, size


def test_a_range_within_one_long_element(spark, tmp_path, ranges):
    doc = [{"a": [{"b": i} for i in range(400)], "s": "}" * 300}, {"a": []}, [[{"c": "]"}]]]
    (tmp_path / "x.json").write_text(json.dumps(doc))
    ranges(100)
    lines = documents._lines(spark, str(tmp_path / "x.json"))
    assert lines.rdd.getNumPartitions() > 40
    assert sorted(key(json.loads(r.value)) for r in documents.elements(spark, str(tmp_path / "x.json")).collect()) == sorted(map(key, doc))


@pytest.mark.parametrize("text", ['[{"a": 1', '[{"a": 1}', '[{"a": "x}]', '{"a": {"b": 1}', '[{"a": 1}]]', '{"a": "'])
def test_what_ends_too_early_is_an_error(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(ValueError, match="ends within"):
        documents.elements(spark, str(tmp_path / "x.json"))


def test_records_with_a_schema_and_at_any_depth(spark, tmp_path, ranges):
    rows = [{"id": i, "t": "}\\{" * (i % 5), "in": {"id": -i, "deep": [{"id": 1000 + i}]}} for i in range(200)]
    (tmp_path / "x.json").write_text(json.dumps(rows))
    ranges(500)
    got = readers.json_elements(spark, str(tmp_path / "x.json"), "id int, t string").collect()
    assert sorted((r.id, r.t) for r in got) == [(x["id"], x["t"]) for x in rows]
    ids = sorted(json.loads(r.record)["id"] for r in readers.nested_records(spark, str(tmp_path / "x.json"), "id").collect())
    assert ids == sorted(k for i in range(200) for k in (i, -i, 1000 + i))
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        (tmp_path / "y.json").write_text('[{"id": nonsense}]')
        readers.json_elements(spark, str(tmp_path / "y.json"), "id int").collect()
