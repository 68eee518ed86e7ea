"""Quality classifier, conversation repair and Merkle manifest: brute force, held-out accuracy and edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import lru_cache
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from compare import compare, connect
from quorumlens.llm import fm, merkle, turns
from quorumlens.llm.queries import QUERIES, SQL

from .conftest import SF, TEXTS


@pytest.mark.parametrize("name", ["op12_conversation_repair", "op13_merkle_manifest"])
def test_sql(spark, name):
    if not Path(SF).exists():
        pytest.skip("no driver tables")
    ok, note = compare(spark, connect(SF), SF, name, SimpleNamespace(run=QUERIES[name], sql=SQL[name]))
    assert ok, note


# Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(level, arity):
    """The root, and for each node the digests left and right of it at each level."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for i, place in enumerate(at):
            first = place // arity * arity
            paths[i].append(("".join(level[first:place]), "".join(level[place + 1:first + arity])))
        level = [h(*level[i:i + arity]) for i in range(0, len(level), arity)]
        at = [place // arity for place in at]
    return level[0], paths


def plain_manifest(rows, arity):
    """Sorted (doc_id, leaf, subroot, root, proof, folded root) by lists in memory; rows are (doc_id, source, lang, n_chars, text)."""
    def leaf_of(row):
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])

    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees, leaves = {}, {}
    for s in order:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        leaves[s] = [leaf_of(r) for r in by_source[s]]
        trees[s] = tree(leaves[s], arity)
    root, upper = tree([trees[s][0] for s in order], arity)
    out = []
    for k, s in enumerate(order):
        for row, leaf, path in zip(by_source[s], leaves[s], trees[s][1], strict=True):
            path, folded = path + upper[k], leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                folded = leaf_of((*row[:4], re.sub("[A-Z]", lambda m: m[0].lower(), row[4])))
            for left, right in path:
                folded = h(left, folded, right)
            out.append((row[0], leaf, trees[s][0], root, h(*[a + b for a, b in path]), folded))
    return sorted(out, key=str)


def every_fifth():
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0


@pytest.mark.parametrize("arity", [2, 3, 16])
def test_manifest_against_lists(spark, arity):
    rnd = random.Random(arity)
    rows = [(i, rnd.choice(["a", "a", "a", "é", "Z", "", None]), rnd.choice([None, "en"]), rnd.choice([None, 7]), rnd.choice([None, "", "Some Text", "ÄÖ É x"])) for i in range(90)]
    rows += [(5, "a", "en", 1, "Twice"), (5, "a", "en", 1, "Twice"), (5, "a", "en", 1, "other"), (None, "a", "en", 1, "Null Id"), (None, None, None, None, None), (7, "alone", "en", 1, "Alone")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("part", F.lit("x")).withColumn("idx", F.lit("y"))
    got = merkle.verify(docs.repartition(5), every_fifth(), arity).collect()
    assert sorted([tuple(r)[:6] for r in got], key=str) == plain_manifest(rows, arity)
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in got)
    assert {r["verified"] for r in got} == {True, False}


def test_manifest_edges(spark, edge, empty):
    rows = merkle.verify(edge, every_fifth()).collect()
    assert len(rows) == len(TEXTS) and len({r["root"] for r in rows}) == 1
    assert merkle.verify(empty, every_fifth()).count() == 0
    one = merkle.verify(edge.filter("doc_id = 6"), F.lit(False)).collect()[0]
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof_sha256"] == h("") and one["verified"]


def test_manifest_does_not_depend_on_partitions(spark, sample):
    a, b = (merkle.manifest(sample.repartition(n)).select("doc_id", "leaf", "subroot", "root") for n in (1, 7))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


# Conversation repair


def plain_repair(rows):
    """cost, audit, repaired text of rows (role, text, fault) by recursion from the end over all edit strings."""
    @lru_cache(None)
    def best(i, state, inserted):
        """Least (cost, audit, lines) from row i on in a state: 0 start, 1 system, 2 user, 3 assistant."""
        step = {0: 2, 1: 2, 2: 3, 3: 2}[state]
        name, ways = {2: "user", 3: "assistant"}[step], []
        if inserted < 2:
            c, a, t = best(i, step, inserted + 1)
            ways.append((c + 3, "I" + a, (f"{name}:", *t)))
        if i == len(rows):
            if state in (0, 3):
                ways.append((0, "", ()))
            return min(ways, default=(10**9, "", ()))
        role, text, fault = rows[i]
        c, a, t = best(i + 1, state, 0)
        ways.append((c + 4, "D" + a, t))
        if fault not in ("blank", "duplicate"):
            late = 3 * (fault == "truncated")
            c, a, t = best(i + 1, step, 0)
            ways.append((c + 3 + late, "R" + a, (f"{name}:{text}", *t)))
            for first, to, allowed in (("s", 1, state == 0), ("u", 2, step == 2), ("a", 3, state == 2)):
                if role[:1] == first and allowed:
                    c, a, t = best(i + 1, to, 0)
                    ways.append((c + late, "K" + a, (f"{role}:{text}", *t)))
        return min(ways)

    cost, audit, lines = best(0, 0, 0)
    return cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def plain_faults(rows):
    """Rows (turn, role, text) in order, with faults and counts."""
    rows = sorted([(t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, out = set(), []
    for _, role, text in rows:
        shown = re.sub("[\x20\x09-\x0d]", "", text)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "fine"
        seen.add((role, text))
        out.append((role, text, fault))
    count = lambda f: sum(x[2] == f for x in out)
    known = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(out, out[1:], strict=False))
    return out, (max(known) - min(known) + 1 - len(set(known)) if known else 0, count("blank"), count("duplicate"), count("truncated"), illegal)


def random_rows(rnd, n):
    roles = ["user", "assistant", "system", "tool", "User", "", None]
    texts = ["One.", "Two!", "three", "Four? \n", "", " \t\n", None, "ünf", "Six.\x0b", "a\nb."]
    return [(rnd.choice([None, *range(-2, 9)]), rnd.choices(roles, [9, 9, 3, 1, 1, 1, 1])[0], rnd.choice(texts)) for _ in range(n)]


def test_repair_against_recursion(spark):
    rnd = random.Random(4)
    convs = {i: random_rows(rnd, rnd.randrange(1, 12)) for i in range(150)}
    convs[None] = random_rows(rnd, 6)
    rows = spark.createDataFrame([(i, *r) for i, c in convs.items() for r in c], "conv_id long, turn long, role string, text string")
    rows = rows.withColumn("key", F.lit("x")).withColumn("fault", F.lit(1)).withColumn("_before", F.lit(2)).repartition(3)
    got = {r["conv_id"]: r for r in turns.repair(rows).collect()}
    assert set(got) == set(convs)
    for i, c in convs.items():
        judged, counts = plain_faults(c)
        assert (got[i]["cost"], got[i]["audit"], got[i]["repaired_sha256"]) == plain_repair(tuple(judged)), (i, judged)
        assert tuple(got[i][n] for n in ("gaps", "blank", "duplicate", "truncated", "illegal")) == counts, i


def test_repair_in_small_blocks(monkeypatch):
    monkeypatch.setattr(turns, "BLOCK", 3)
    rnd, convs = random.Random(5), {}
    for i in range(40):
        convs[str(i)] = plain_faults(random_rows(rnd, rnd.randrange(1, 30)))[0]
    kinds = ["fine", "blank", "duplicate", "truncated"]
    flat = [(k, True, n, role, text, kinds.index(fault), False) for k, c in convs.items() for n, (role, text, fault) in enumerate(c)]
    names = ["key", "known", "turn", "role", "text", "fault", "gone"]
    batches = [pd.DataFrame(flat[i:i + 7], columns=names) for i in range(0, len(flat), 7)]
    steps = pd.concat(turns.forward(iter(batches)))
    assert steps.groupby("key")["block"].max().max() >= 9
    steps = steps.sort_values(["key", "block"], ascending=[True, False])
    found = pd.concat(turns.backward(iter([steps.iloc[i:i + 4] for i in range(0, len(steps), 4)])))
    got = {r.key: (r.cost, r.audit, r.repaired_sha256) for r in found.itertuples()}
    assert got == {k: plain_repair(tuple(c)) for k, c in convs.items()}


def test_repair_edges(spark):
    schema = "conv_id long, turn long, role string, text string, gone boolean"
    rows = [(1, 0, "user", "Hi.", True), (2, None, None, None, False), (3, 0, "system", "S.", False), (4, 0, "user", "Q?", False), (4, 1, "assistant", "A.", False),
            (5, -(1 << 63), "user", "x" * 100_000 + ".", False), (5, (1 << 63) - 1, "assistant", "A.", False), (6, 3, "user", "Same.", False), (6, 3, "user", "Same.", False)]
    got = {r["conv_id"]: r for r in turns.repair(spark.createDataFrame(rows, schema)).collect()}
    assert tuple(got[1])[1:] == (0, 0, 0, 0, 0, 0, "", h(""))
    assert (got[2]["blank"], got[2]["cost"], got[2]["audit"]) == (1, 4, "D") and (got[3]["cost"], got[3]["audit"]) == (4, "D")
    assert (got[4]["cost"], got[4]["audit"], got[4]["repaired_sha256"]) == (0, "KK", h("user:Q?\nassistant:A.")) and got[5]["gaps"] == (1 << 63) - 1
    assert (got[6]["duplicate"], got[6]["audit"], got[6]["gaps"]) == (1, "KDI", 0)
    assert turns.repair(turns.damaged(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
    thousands = spark.range(20_000).selectExpr("1L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id, '.') AS text")
    one = turns.repair(thousands).collect()
    assert len(one) == 1 and one[0]["audit"] == "K" * 20_000 and one[0]["cost"] == 0


def test_damage(spark):
    rows = spark.createDataFrame([(1, t, "assistant", "A. b!") for t in range(60)] + [(1, None, None, None)], "conv_id long, turn long, role string, text string")
    got = turns.damaged(rows).collect()
    for t in [None, *range(60)]:
        kind = zlib.crc32(f"1:{' ' if t is None else t}".encode()) % 20
        mine = [r for r in got if r["turn"] == t]
        assert len(mine) == (2 if kind == 3 else 1) and all(r["gone"] == (kind == 0) for r in mine)
        if t is not None:
            assert {r["text"] for r in mine} == {{1: "", 2: "A b"}.get(kind, "A. b!")} and {r["role"] for r in mine} == {"user" if kind == 4 else "assistant"}


# Quality classifier


def test_held_out_quality(spark):
    sf = SF.replace("0.001", "0.01")
    if not Path(sf).exists():
        pytest.skip("no driver tables")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op11_quality_classifier"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [(r["score"], r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, _, y in held if y], [s for s, _, y in held if not y]
    assert np.mean([p == y for _, p, y in held]) > 0.95 and np.mean([[a > b for b in bad] for a in good]) > 0.99


def test_sum_of_squares_is_all_pairs():
    draw = np.random.default_rng(3)
    m = fm.Machine(np.zeros((len(fm.STATISTICS), fm.STEPS - 1)), 0.3, draw.normal(size=40), draw.normal(size=(40, 5)))
    columns = [np.array([3, 7, 20]), np.array([1]), np.array([0, 5, 9, 39])]
    values = [draw.normal(size=len(c)) for c in columns]
    x = fm.Sparse(np.cumsum([0, *map(len, columns)]), np.concatenate(columns), np.concatenate(values))
    for row, (c, v) in enumerate(zip(columns, values, strict=True)):
        pairs = sum(m.factors[c[i]] @ m.factors[c[j]] * v[i] * v[j] for i in range(len(c)) for j in range(i))
        assert m.margins(x)[row] == pytest.approx(0.3 + m.linear[c] @ v + pairs)


def test_features_against_lists():
    texts = ["One two two!! THREE %%% 4\nOne\nOne", "", None, "é è é", "   \n ", "x"]
    stats = dict(zip(fm.STATISTICS, fm.statistics(pa.array(texts)).T, strict=True))
    assert stats["n_words"][0] == pytest.approx(np.log1p(8)) and stats["repeats"][0] == pytest.approx(1 / 8)
    assert stats["different_lines"][0] == pytest.approx(2 / 3) and stats["bare"][0] == pytest.approx(2 / 8) and stats["mark_after_mark"][0] == pytest.approx(3 / len(texts[0]))
    assert stats["different_words"][0] == pytest.approx(6 / 8) and all(stats[n][1] == stats[n][2] == 0 for n in fm.STATISTICS)
    bounds, columns, values = fm.hashed_words(pa.array(texts))
    assert np.diff(bounds).tolist() == [6, 0, 0, 2, 0, 1] and (values[bounds[3]:bounds[4]] ** 2).sum() == pytest.approx(1, abs=1e-6)


def test_quality_edges(spark, edge, empty):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(1, 15)] + [(None, 1, "x"), (99, 0, "x"), (6, None, "x"), (7, 0, "x"), (7, 0, "x")], "doc_id long, quality int, text string")
    rows = fm.classify(edge, labels).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[4]["score"] == by[4]["score"] and [r["held_out"] for r in rows if r["doc_id"] is None] == [True, True]
    assert fm.classify(empty, labels).count() == 0
    assert {r["score"] for r in fm.classify(edge, labels.limit(0)).collect()} == {0.5}
    assert {(r["score"], r["predicted"]) for r in fm.classify(edge, labels.filter("quality = 1")).collect()} == {(1.0, 1)}
    bounded = fm.sample(edge, labels, most_rows=4)
    assert bounded.num_rows <= 4
    same = [r["score"] for r in rows if r["doc_id"] == 13]
    assert same[0] == same[1]
