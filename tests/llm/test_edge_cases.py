"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quorumlens.llm import ann, decontaminate, langid, license, linededup, lm, neardup, pack, shard, substring
from quorumlens.llm.components import components
from quorumlens.llm.tokens import VOCABULARY

from .conftest import LONG_LINE, TEXTS

N = len(TEXTS)


def items(spark):
    return spark.createDataFrame(
        [(1, LONG_LINE.upper(), "x"), (2, "word", "x"), (3, None, "x"), (4, "...", "x"), (None, "no id at all", "x"), (1, LONG_LINE, "x")],
        "item_id long, text string, words string")


def by_id(rows):
    return {r["doc_id"]: r for r in rows if r["doc_id"] is not None}


def test_decontamination(spark, edge):
    rows = decontaminate.contamination(edge, items(spark)).collect()
    assert len(rows) == N
    got = by_id(rows)
    assert got[1]["items"] == ["1"] and got[1]["n_hit"] == 24 and got[6]["items"] == ["2"] and got[6]["n_hit"] == 1
    assert got[3]["n_words"] == got[3]["n_hit"] == 0 and got[8]["n_hit"] == 0 and got[11]["n_hit"] == 48
    assert got[14]["n_hit"] == 23 and [m["terms"] for m in got[14]["near"] if m["start"] == 11] == [12]
    assert [r["items"] for r in rows if r["doc_id"] is None and r["n_words"]] == [[""]]


def test_decontamination_in_blocks(spark, edge):
    one = decontaminate.contamination(edge.filter("doc_id <> 13"), items(spark))
    many = decontaminate.contamination(edge.filter("doc_id <> 13"), items(spark), block_bytes=64)
    key = lambda df: sorted((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in df.collect())
    assert key(one) == key(many)


def test_decontamination_without_items_or_rows(spark, edge, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in decontaminate.contamination(edge, none).collect()} == {0}
    assert decontaminate.contamination(empty, items(spark)).count() == 0


def test_near_duplicates(edge):
    rows = neardup.near_duplicates(edge).collect()
    assert len(rows) == N
    got = by_id(rows)
    assert got[2]["class_id"] == 1 and got[14]["class_id"] == 1 and got[7]["class_id"] == 6 and got[13]["class_size"] == 2
    assert got[3]["class_id"] == 3 and got[4]["class_id"] == 4 and got[5]["class_id"] == 5 and got[9]["class_id"] == 9


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    names = {r["node"]: r["component"] for r in components(edges).collect()}
    assert len({names[i] for i in range(41)}) == 1 and names[100] == names[101] and names[100] != names[0] and len(names) == 43


def test_line_dedup(edge):
    rows = linededup.drop_repeated_lines(edge).collect()
    assert len(rows) == N and "segment" in rows[0].asDict()
    got = by_id(rows)
    assert got[1]["text"] == LONG_LINE and got[2]["text"] == "" and got[11]["text"] == "" and [tuple(r) for r in got[11]["runs"]] == [(0, 2)]
    assert got[3]["text"] is None and got[5]["text"] == " \n\t \n" and got[7]["text"] == "word" and got[13]["n_removed"] == 0


def test_scores(edge):
    rows = lm.score_documents(edge).collect()
    assert len(rows) == N
    got = by_id(rows)
    assert got[3]["n_tokens"] == got[4]["n_tokens"] == 1 and got[10]["n_tokens"] == 20001
    assert got[1]["score"] == got[2]["score"] and all(np.isfinite(r["score"]) and r["score"] < 0 for r in rows)


def test_attention_learns_from_all_training_documents(spark, monkeypatch):
    texts = [f"alpha{i % 7} beta gamma{i % 5} delta epsilon" for i in range(lm.SAMPLE_DOCS + 200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    used = np.zeros(lm.end_id(VOCABULARY) + 1)
    stream, starts = lm.streams(lm.subwords(docs.select("text").toArrow(), VOCABULARY), lm.end_id(VOCABULARY))
    np.add.at(used, stream, 1)
    encoded = lambda d: lm.encode_segments(d.withColumn("held_out", F.lit(False)), VOCABULARY, 100)
    keys, n = lm.id_pairs(encoded(docs), used, VOCABULARY)
    want, m = lm.pairs_of(stream, starts, lm.columns(used))
    assert dict(zip(keys.tolist(), n.tolist())) == dict(zip(want.tolist(), m.tolist())) and n.sum() == len(stream) - len(texts)
    other = docs.withColumn("text", F.when(F.xxhash64(F.lit("lm"), "doc_id") == docs.agg(F.max(F.xxhash64(F.lit("lm"), "doc_id"))).first()[0], "epsilon delta").otherwise(F.col("text")))
    monkeypatch.setattr(lm, "id_pairs", lambda *_: (keys, n))  # the same classes, so that only training differs
    a, again, b = (lm.fit(d, encoded(d), used, VOCABULARY).flat() for d in (docs, docs, other))
    assert np.allclose(a, again, rtol=0, atol=1e-6) and not np.allclose(a, b, rtol=0, atol=1e-6)  # the last document of the draw counts too


def test_shards(edge):
    rows = shard.shard_documents(edge, 8).collect()
    assert len(rows) == N and len({(r["shard"], r["slot"]) for r in rows}) == N
    assert {r["size"] for r in rows if r["doc_id"] in (3, 4)} == {1}
    assert all(r["grown_shard"] in (r["shard"], 8) for r in rows)


def test_packing(edge):
    rows = pack.pack(edge, VOCABULARY, 2048).collect()
    assert sum(r["piece"] == 0 for r in rows) == N and all(0 < r["length"] <= 2048 for r in rows)
    long = sorted((r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == 10)
    assert [x[2] for x in long[1:]] == [2048] * (len(long) - 1) and long[1][1] == long[0][2]
    assert {r["length"] for r in rows if r["doc_id"] in (3, 4)} == {1}


def test_few_open_bins():
    bins = pack.BestFit(10, 2)
    assert [bins.put(n) for n in (6, 7, 5, 4, 3, 10)] == [(0, 0), (1, 0), (2, 0), (0, 6), (2, 5), (3, 0)]


def test_neighbours(spark):
    vectors = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]),
               (7, [1.0, 1.0]), (8, [1.0, 0.0, 0.0]), (9, []), (0, [1.0, 0.0]), (None, [1.0, 0.0])]
    rows = spark.createDataFrame([(i, v, "x", "y") for i, v in vectors], "vec_id long, embedding array<double>, block string, rank string")
    got = ann.nearest(rows.dropDuplicates(), F.col("vec_id") == 0, 5).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in got] == [(1, 1), (2, 7), (3, 2)]
    assert got[1]["score"] == pytest.approx(2**-0.5)
    assert ann.nearest(rows.limit(0), F.col("vec_id") == 0, 5).count() == 0


def test_substrings(edge):
    rows = substring.drop_repeats(edge).collect()
    assert len(rows) == N
    got = by_id(rows)
    assert got[2]["n_removed"] == 24 and got[2]["kept_text"] == "" and got[1]["n_removed"] == 0 and got[3]["n_words"] == 0
    assert got[10]["n_removed"] == 20000 - 10 and [tuple(s) for s in got[14]["spans"]] == [(0, 23)]


MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights"""
GPL_TEXT = """ * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License"""


def test_licences_across_lines_and_in_long_lines(spark):
    far = " ".join(f"plain{i} word" for i in range(1500))
    texts = {
        1: ("Some words.\n\n" + MIT_TEXT, [(2, "mit")]), 2: (GPL_TEXT, [(0, "gpl")]),
        3: ("Licensed under the MIT license or the Apache License, Version 2.0", [(0, "apache"), (0, "mit")]),
        4: ("Licensed under the Apache License, Version 2.0 or the MIT license", [(0, "apache"), (0, "mit")]),
        5: (f"{far} released under the MIT License {far}", [(0, "mit")]),
        6: (GPL_TEXT.replace("GNU General", "GNU Affero General"), [(0, "agpl")]),
        7: (GPL_TEXT.replace("GNU General", "GNU Lesser General"), [(0, "lgpl")]),
        8: ("Licensed under CC BY-NC 4.0.", [(0, "cc-by-nc")]), 9: ("Released under\n\nthe MIT License", []),
        10: ("All rights reserved.\nReleased under the MIT License.\nReleased under the MIT License.", [(0, "reserved"), (1, "mit"), (2, "mit")]),
        11: (far, [])}
    rows = by_id(license.scan(spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id long, text string")).collect())
    assert {i: sorted((x["paragraph"], x["family"]) for x in rows[i]["licences"]) for i in texts} == {i: want for i, (_, want) in texts.items()}
    assert rows[1]["n_paragraphs"] == 2


def test_licences(edge, spark):
    assert {r["n_paragraphs"] for r in license.scan(edge).collect() if r["doc_id"] in (3, 4, 5)} == {0}
    docs = spark.createDataFrame([(1, "Some words.\nReleased under the MIT License.\n\nOther words."), (2, None), (3, "the license of a dog")], "doc_id long, text string")
    got = by_id(license.scan(docs).collect())
    assert [(x["paragraph"], x["family"]) for x in got[1]["licences"]] == [(1, "mit")] and not got[2]["licences"] and not got[3]["licences"]


def test_languages(edge):
    rows = langid.identify(edge).collect()
    assert len(rows) == N and by_id(rows)[3]["lang_pred"] == by_id(rows)[8]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in rows)
    unlabelled = langid.identify(edge.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}


OPERATORS = {
    "near": neardup.near_duplicates, "lines": linededup.drop_repeated_lines, "lm": lm.score_documents, "shard": shard.shard_documents,
    "pack": lambda d: pack.pack(d, VOCABULARY), "substring": substring.drop_repeats, "licence": license.scan, "language": langid.identify}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, name):
    assert OPERATORS[name](empty).count() == 0


def test_pipeline_stages(spark, edge, empty, tmp_path):
    items(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, nothing = edge, empty
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)))
        assert docs.columns == columns, name
        nothing = stage(spark, nothing, str(tmp_path))
        assert nothing.count() == 0
    ids = sorted(r["doc_id"] for r in docs.collect() if r["doc_id"] is not None)
    assert 9 in ids and 10 in ids and 12 in ids and 1 not in ids and 3 not in ids and ids.count(13) == 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()

