"""Text metrics counted in the row, against n-grams counted one by one."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quorumlens.functions import text as X
from quorumlens.functions import vectors as V
from quorumlens.operators import judge as J
from quorumlens.operators import textmetrics as TM


def grams(words: list[str], n: int) -> Counter:
    return Counter(tuple(words[i:i + n]) for i in range(len(words) - n + 1))


def pair_rows(size: int) -> list[tuple]:
    """Ids of one row, ids of several, null ids, null and empty texts."""
    rng = random.Random(5)
    text = lambda: rng.choice([None, "", " ".join(rng.choices(["a", "b", "It's", "c!", "D."], k=rng.randint(0, 12)))])
    rows = [(f"r{i}", text(), text()) for i in range(size)]
    return rows + [("twice", "a b a b", "a b"), ("twice", "a b", "b a b a"), (None, "a a", "a"), (None, "b", "b a"), ("none", "", None)]


def wanted(rows: list[tuple], upto: int) -> dict:
    split = lambda t: "".join(c if c.isalnum() or c == "'" else " " for c in (t or "").lower()).split()
    out: dict = {}
    for rid, h, r in rows:
        for n in range(1, upto + 1):
            for side, t in (("h", h), ("r", r)):
                out.setdefault(rid, {}).setdefault((n, side), Counter()).update(grams(split(t), n))
    found = {rid: tuple(x for n in range(1, upto + 1) for x in (
        sum((c[n, "h"] & c[n, "r"]).values()), sum(c[n, "h"].values()), sum(c[n, "r"].values()))) for rid, c in out.items()}
    return {rid: x for rid, x in found.items() if x[1] + x[2]}


@pytest.mark.parametrize("upto", [2, 4])
def test_gram_stats(spark, monkeypatch, upto):
    monkeypatch.setattr(TM, "SLICE_TOKENS", 40)  # several slices in a batch
    rows = pair_rows(60)
    df = spark.createDataFrame(rows, "id string, hyp string, ref string").coalesce(2)
    got = [tuple(r) for r in TM.gram_stats(df, "id", "hyp", "ref", upto).select("id", *[f"{c}{n}" for n in range(1, upto + 1) for c in "ohr"]).collect()]
    assert len(got) == len({r[0] for r in got})
    assert {r[0]: r[1:] for r in got} == wanted(rows, upto)


def test_texts_are_not_shuffled(spark):
    """Of rows with ids of their own only the ids are shuffled."""
    df = spark.createDataFrame([(f"r{i}", "a b c", "b c d", "c d") for i in range(9)], "id string, hyp string, ref string, ctx string")
    for out in (TM.gram_stats(df, "id", "hyp", "ref"), TM.per_example(df, "id", "hyp", "ref", "ctx")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        own = "\n".join(x for x in plan.split("Union", 1)[1].splitlines() if x.lstrip().startswith(":"))
        assert "LeftAnti" in own and "strategy=broadcast" in own and "Generate" not in own and "Aggregate" not in own and "Repartition" not in own


def test_per_example_keeps_rows_that_share_an_id(spark):
    """rows of one id get the counts of all of them; rows without an id and rows without words get zeros."""
    rows = [(rid, h, r, "a c") for rid, h, r in pair_rows(20)]
    df = spark.createDataFrame(rows, "id string, hyp string, ref string, ctx string")
    got = TM.per_example(df, "id", "hyp", "ref", "ctx").collect()
    assert sorted((str(r["id"]), str(r["hyp"]), str(r["ref"])) for r in got) == sorted((str(a), str(b), str(c)) for a, b, c, _ in rows)
    want = wanted([r[:3] for r in rows], 4)
    for r in got:
        o, h, t = want.get(r["id"], (0, 0, 0))[:3] if r["id"] is not None else (0, 0, 0)
        assert abs(r["rouge_1"] - (2 * o / (h + t) if o else 0.0)) < 1e-12, r
        assert r["words"] == len(words_of(r["hyp"])) and r["empty"] == (r["words"] == 0)


def words_of(t: str | None) -> list[str]:
    return "".join(c if c.isalnum() or c == "'" else " " for c in (t or "").lower()).split()


@pytest.mark.parametrize("smoothed", [False, True])
def test_self_bleu_counts_in_the_row(spark, monkeypatch, smoothed):
    """against rows of n-grams, which rows that share an id still go through; ids of a row are not shuffled with n-grams."""
    monkeypatch.setattr(TM, "SLICE_TOKENS", 40)
    rows = [(i % 2, rid, h) for i, (rid, h, _) in enumerate(pair_rows(40))]
    df = spark.createDataFrame(rows, "system int, id string, text string")
    got = {r["system"]: r["self_bleu"] for r in TM.self_bleu(df, ["system"], "id", "text", None, 4, smoothed).collect()}
    monkeypatch.setattr(TM, "_split_by_id", lambda d, *ids: (d.limit(0), d))
    want = {r["system"]: r["self_bleu"] for r in TM.self_bleu(df, ["system"], "id", "text", None, 4, smoothed).collect()}
    assert got.keys() == want.keys() == {0, 1}
    assert all(abs(got[k] - want[k]) < 1e-12 and got[k] > 0 for k in got)


def test_hashed_tokens_in_slices(spark, monkeypatch):
    """The vectors don't depend on how many tokens a task hashes at a time."""
    df = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(pair_rows(60))], "id int, text string").coalesce(1)
    vectors = lambda: {r["id"]: [tuple(e) for e in r["f"]] for r in df.select("id", V.hashed_tokens(X.tokens(F.col("text")), 16).alias("f")).collect()}
    whole = vectors()
    monkeypatch.setattr(V, "SLICE_TOKENS", 5)
    assert vectors() == whole and any(whole.values())


def test_permutation_sums_in_slices(monkeypatch):
    """sums of a task don't depend on the cells it holds at a time, and no array is larger."""
    rows = pd.DataFrame({"stratum": ["x", "y", None] * 20, "l": [[0, 2], [1], [0, 1]] * 20, "a": [[0.5, 0.5], [1.0], [0.2, 0.8]] * 20, "b": [[1.0, 0.0], [0.0], [0.6, 0.4]] * 20})
    args = (["p", "q", "r"], [[1.0, 0.0], [0.25, 0.75], [0.0, 1.0]], 9, 1, 2)
    sums = lambda: {r["stratum"]: (r["n"], r["sums"]) for r in next(J._divergence_sums(*args)([rows])).to_dict("records")}
    whole = sums()
    sizes = []
    monkeypatch.setattr(J, "TASK_CELLS", 100)
    monkeypatch.setattr(J.np, "clip", lambda x, *a, clip=np.clip: (sizes.append(x.size), clip(x, *a))[1])
    for k, (n, s) in sums().items():
        assert n == whole[k][0] and np.allclose(s, whole[k][1], atol=1e-12)
    assert max(sizes) * 2 <= 100
