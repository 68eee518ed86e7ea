"""Files round trip through readers and writers."""

from __future__ import annotations

import gzip
import json

from quorumlens.sources import scans as S
from quorumlens.sources import sinks as W
from quorumlens.streaming import resume


def test_nested_files(spark, tmp_path):
    for ann, label in (("m1", "x"), ("m2", "y")):
        d = tmp_path / ann
        d.mkdir()
        conv = [{"dialogue_id": "c1", "situation": "s", "turns": [
            {"turn_id": 0, "speaker": "A", "utterance": "hi", "emoji_annotation": {"selected_emoji": label, "confidence": 4}},
            {"turn_id": 1, "speaker": "listener", "utterance": "yo", "annotation": {"label": "z"}}]}]
        (d / "valid_emoji_annotations.json").write_text(json.dumps(conv))
    got = S.flatten_dialogues(S.read_annotations(spark, str(tmp_path))).orderBy("annotator", "turn").collect()
    assert [(r.annotator, r.turn, r.split, r.role, r.label, r.confidence) for r in got] == [
        ("m1", 0, "dev", "A", "x", 4.0), ("m1", 1, "dev", "B", "z", 1.0), ("m2", 0, "dev", "A", "y", 4.0), ("m2", 1, "dev", "B", "z", 1.0)]


def test_vote_formats(spark, tmp_path):
    row = {"dialogue_id": "1", "turn_id": 3, "split": "valid", "role": "listener", "text": "a, b", "model": "m", "emoji": "e", "confidence": 2.0}
    (tmp_path / "v.json").write_text(json.dumps({"records": [row, row]}))
    (tmp_path / "w.json").write_text(json.dumps([row]))
    (tmp_path / "v.jsonl").write_text(json.dumps(row) + "\n")
    (tmp_path / "v.csv").write_text(",".join(row) + "\n" + ",".join(f'"{v}"' for v in row.values()) + "\n")
    spark.createDataFrame([row]).write.parquet(str(tmp_path / "v.parquet"))
    counts = {}
    for name, fmt in (("v.json", "json"), ("w.json", "json"), ("v.jsonl", "jsonl"), ("v.csv", "csv"), ("v.parquet", "parquet")):
        got = S.read_votes(spark, str(tmp_path / name), fmt).collect()
        counts[name] = len(got)
        assert all((r.conv_id, r.turn, r.split, r.role, r.text, r.confidence) == ("1", 3, "dev", "B", "a, b", 2.0) for r in got)
    assert counts == {"v.json": 2, "w.json": 1, "v.jsonl": 1, "v.csv": 1, "v.parquet": 1}


def test_metadata_files(spark, tmp_path):
    v = spark.createDataFrame([("m", "dev", "c", 0, "A", "é", 3, "secret")], "annotator string, split string, conv_id string, turn long, role string, label string, confidence long, text string")
    rec = W.metadata_records(W.metadata_turns(v))
    out = str(tmp_path / "out")
    W.write_metadata(rec, out)
    files = list((tmp_path / "out" / "annotator=m" / "split=dev").glob("*.gz"))
    line = json.loads(gzip.open(files[0], "rt").read())
    assert line["dialogue_id"] == "c" and line["turn_annotations"][0]["unicode"] == "U+00E9" and "secret" not in json.dumps(line)
    assert W.manifest(rec).first().content_sha256 == W.manifest(rec.repartition(3)).first().content_sha256


def test_resume_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "gen")
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "system string, example long")
    resume.write_partitions(df, path, "system")
    resume.write_partitions(df.filter("system = 'b'"), path, "system")
    done = spark.read.parquet(path)
    assert done.count() == 3
    state = {r.system: r.complete for r in resume.output_state(df, done.filter("example = 1"), "system", "example").collect()}
    assert state == {"a": False, "b": True}
