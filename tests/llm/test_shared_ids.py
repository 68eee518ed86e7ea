"""Rows that share an id, or have none, but not the text or vector: each stands for itself."""

import hashlib

from pyspark.sql import functions as F

import corpus_pipeline
from quorumlens.llm import ann, decontaminate, linededup, neardup

WORDS = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel", "india", "juliett", "kilo", "lima", "mike"]


def text(seed, n=60):
    return " ".join(f"{WORDS[int(hashlib.md5(f'{seed}{i}'.encode()).hexdigest(), 16) % 13]}{seed}{i % 7}" for i in range(n))


A, B, C = text("a"), text("b"), text("c")
NEAR_A = A + " one two"
RUN = "\n".join(" ".join(WORDS[i:i + 6]) for i in (0, 6, 3))


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_near_duplicates(spark):
    """Text A is the copy of 2 in one row of id 5 and absent from the other; its link to 9 and the rows without an id stay."""
    rows = docs(spark, [(5, A), (5, B), (2, B), (9, NEAR_A), (None, A), (None, C), (None, C)])
    got = {(r["doc_id"], r["text_key"]): r for r in neardup.near_duplicates(rows).collect()}
    key = {t: rows.select(F.xxhash64(F.lit(t))).first()[0] for t in (A, B, C, NEAR_A)}
    assert got[5, key[A]]["class_id"] == got[9, key[NEAR_A]]["class_id"] == 5 and got[5, key[A]]["class_size"] == 3
    assert got[5, key[B]]["class_id"] == got[2, key[B]]["class_id"] == 2
    assert got[None, key[A]]["class_key"] == got[5, key[A]]["class_key"] and got[None, key[C]]["class_size"] == 2
    kept = {(r["doc_id"], r["text"]) for r in corpus_pipeline.near_copies(spark, rows, "").collect()}
    assert kept == {(5, A), (2, B), (None, A), (None, C)}


def test_near_copies_of_one_id(spark):
    """Of near copies with one id a single row stays, of other texts with that id each, of repeated rows one."""
    rows = docs(spark, [(5, A), (5, NEAR_A), (5, B), (5, B), (5, None), (6, "")])
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_copies(spark, rows, "").collect()]
    assert len(kept) == 4 and {t for _, t in kept} in ({A, B, None, ""}, {NEAR_A, B, None, ""})


def test_line_dedup(spark):
    """A clean text keeps its lines beside a copy with the same id; a copy without an id loses them; repeated rows are one document."""
    rows = docs(spark, [(1, RUN), (5, RUN + "\nend"), (5, B + "\n" + C), (None, "start\n" + RUN), (7, C), (7, C), (7, B)])
    got = sorted((str(r["doc_id"]), r["text"], r["n_removed"]) for r in linededup.drop_repeated_lines(rows).collect())
    # B and C are lines of id 5 first, so id 7 loses them.
    assert got == sorted([("1", RUN, 0), ("5", "end", 3), ("5", B + "\n" + C, 0), ("None", "start", 3), ("7", "", 1), ("7", "", 1), ("7", "", 1)])


def test_neighbours(spark):
    """Seven rows of the query's id, and ids that stand in several rows with other vectors."""
    rows = [(0, [1.0, 0.0])] * 7 + [(1, [1.0, 0.0])] * 7 + [(2, [1.0, 0.1]), (2, [1.0, 0.2]), (2, [0.0, 1.0]), (3, [1.0, 0.3])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 3).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 3)]
    assert abs(got[1]["score"] - 1 / (1.01 ** 0.5)) < 1e-12


def test_decontamination_in_blocks(spark):
    """The number of blocks doesn't change the rows, whatever ids they share."""
    items = spark.createDataFrame([(i, text(s)) for i, s in enumerate("xyz")], "item_id long, text string")
    rows = docs(spark, [(None, text("x")), (None, A), (5, text("y") + " " + A), (5, B), (5, B), (6, None)])
    read = lambda size: sorted(str((r["doc_id"], r["n_words"], r["n_hit"], sorted(r["items"]))) for r in decontaminate.contamination(rows, items, block_bytes=size).collect())
    assert read(64) == read(1 << 24) and len(read(64)) == 6
