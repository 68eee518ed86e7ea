"""Readers that cut files, against Spark's multi-line readers of whole files."""

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from quorumlens.sources import splits

SCHEMA = "id long, text string, turns array<struct<a: string, b: array<long>>>"
TEXT = ['{', '}', '[', ']', '"', "\\", ",", "\n", "é", "}]", '{"x": [', "word ", ""]


@pytest.fixture
def small_blocks(spark):
    """Blocks of some hundred bytes, so that most records meet a border."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def objects(n, seed):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choices(TEXT, k=rng.choice([0, 2, 8, 60, 400 if rng.random() < 0.1 else 3])))
    return [{"id": i, "text": text(), "turns": [{"a": text(), "b": list(range(rng.randrange(3)))} for _ in range(rng.randrange(3))]} for i in range(n)]


def rows(df):
    return sorted(df.select(F.to_json(F.struct("id", "text", "turns"))).toPandas().iloc[:, 0])


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("ascii_only", [True, False])
def test_json_arrays(spark, tmp_path, small_blocks, indent, ascii_only):
    for k in range(3):
        (tmp_path / f"a{k}.json").write_text(json.dumps(objects(40, k), indent=indent, ensure_ascii=ascii_only), encoding="utf-8")
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "none.json").write_text(" [ ]\n")
    path = str(tmp_path)
    got = splits.read_json(spark, path, SCHEMA)
    want = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    assert rows(got) == rows(want) and got.count() == 120
    assert {f.rsplit("/", 1)[1] for (f,) in got.select("_file").distinct().collect()} == {"a0.json", "a1.json", "a2.json"}


def test_wrapped_arrays_and_single_objects(spark, tmp_path, small_blocks):
    """What follows a wrapped array is no record, however deep; an object of another shape is read whole."""
    (tmp_path / "w.json").write_text(json.dumps({"records": objects(30, 5), "meta": {"id": 7, "x": [{"id": 8}] * 60}}))
    (tmp_path / "s.json").write_text(json.dumps({"id": 99, "text": "one", "other": [1]}))
    got = splits.read_json(spark, str(tmp_path), SCHEMA, ["records"])
    assert sorted(r["id"] for r in got.collect()) == [*range(30), 99]


def test_many_tasks_read_one_file(spark, tmp_path, small_blocks):
    (tmp_path / "a.json").write_text(json.dumps(objects(200, 1)))
    _, starts = splits._records(spark, str(tmp_path), "}", {}, splits._json_states, splits._json_cut, ())
    assert starts.count() > 20 and starts.filter("closed").count() <= 1


def test_csv(spark, tmp_path, small_blocks):
    """Line feeds and quotes inside quotes; files with other orders of columns, line ends and missing columns."""
    schema = "id long, text string, note string"
    want = []
    for k, (end, columns) in enumerate([("\n", ["id", "text", "note"]), ("\r\n", ["note", "id", "text"]), ("\n", ["text", "id"])]):
        data = [{"id": 1000 * k + i, "text": o["text"].replace("\\", "/") or "x", "note": f"n {i},"} for i, o in enumerate(objects(60, 20 + k))]
        with open(tmp_path / f"{k}.csv", "w", newline="", encoding="utf-8") as f:
            w = csv.DictWriter(f, columns, lineterminator=end, extrasaction="ignore", quoting=csv.QUOTE_ALL if k else csv.QUOTE_MINIMAL)
            w.writeheader()
            w.writerows(data)
        want += [(d["id"], d["text"], d["note"] if "note" in columns else None) for d in data]
    (tmp_path / "none.csv").write_text("id,text\n")
    got = [(r["id"], r["text"], r["note"]) for r in splits.read_csv(spark, str(tmp_path), schema).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
