"""Each operator against a plain program over the smallest driver tables, and the SQL of those that have it."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from quorumlens.llm import linededup, lm, neardup
from quorumlens.llm.decontaminate import contamination, is_contaminated
from quorumlens.llm.queries import QUERIES, SQL
from quorumlens.llm.shard import jump_hash
from quorumlens.llm.tokens import VOCABULARY, encoder, vocabulary_path
from quorumlens.llm.words import LOWER, PLAIN, Words, pack_sorted, unpack_sorted

from .conftest import SF

PLAIN_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def texts(sample):
    return {r["doc_id"]: r["text"] for r in sample.select("doc_id", "text").collect()}


def lower(text):
    return bytes(LOWER[np.frombuffer((text or "").encode(), np.uint8)])


def test_words_are_those_of_the_pattern(sample):
    t = [*texts(sample).values(), None, "", "a", "ab", "é", " é x", "A-B"]
    got = Words(pa.array(t), PLAIN, lower=True)
    want = [PLAIN_WORD.findall(lower(x)) for x in t]
    assert got.counts.tolist() == [len(w) for w in want]
    flat = [x.decode() for w in want for x in w]
    assert [got.text(k) for k in range(len(flat))] == flat
    of = {}
    for h, x in zip(got.hashes().tolist(), flat):
        assert of.setdefault(h, x) == x
    assert len(of) == len(set(flat))
    h = np.unique(got.hashes())
    assert (unpack_sorted(pack_sorted(h)) == h).all()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    class Entry:
        run = staticmethod(QUERIES[name])
        sql = SQL[name]

    ok, note = compare(spark, connect(SF), SF, name, Entry)
    assert ok, note


def test_near_duplicates(sample):
    found, docs = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(sample, segment_rows=30).collect()}, texts(sample)
    words = {i: tuple(PLAIN_WORD.findall(lower(t))) for i, t in docs.items()}
    first = {}
    for i in sorted(words):
        first.setdefault(words[i] or i, i)
    counts = {i: collections.Counter(w[k:k + 5] for k in range(max(1, len(w) - 4))) for i, w in words.items() if w}
    df = collections.Counter(s for i in first.values() if words[i] for s in counts[i])
    n = len({w for w in words.values() if w})
    weight = {i: {s: float(np.float32(k * neardup.inverse_frequency(np.array(df[s]), n))) for s, k in c.items()} for i, c in counts.items()}
    parent = {i: i for i in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(weight)
    for a in ids:
        for b in ids:
            if a < b and len(weight[a].keys() & weight[b].keys()) > 0:
                both = sum(min(w, weight[b][s]) for s, w in weight[a].items() if s in weight[b])
                if both / (sum(weight[a].values()) + sum(weight[b].values()) - both) >= 0.8:
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    assert found == {i: root(i) for i in docs}


def longest_runs(docs, least=10):
    """The lines of each text in the longest run from some line that starts earlier too, if it has `least` words."""
    seen, out = [], {}
    for i, text in sorted(docs.items()):
        lines = [(n, x.strip()) for n, x in enumerate((text or "").split("\n")) if x.strip()]
        flat, gone = [x for _, x in lines], set()
        for p in range(len(flat)):
            size = 0
            for other, q in seen:
                k = 0
                while p + k < len(flat) and q + k < len(other) and flat[p + k] == other[q + k]:
                    k += 1
                size = max(size, k)
            if sum(len(x.split()) for x in flat[p:p + size]) >= least:
                gone |= {n for n, _ in lines[p:p + size]}
            seen.append((flat, p))
        out[i] = gone
    return out


def test_line_dedup_takes_whole_runs(spark):
    one, rng = "a b c d e f g h i j k l", np.random.default_rng(3)
    docs = {1: f"{one}\nm n o\nother", 2: f"x\n{one}\n\nm n o\nlast", 3: f"{one}\nm n o"}
    for i in range(4, 60):  # short lines, so that runs of many lines repeat, and overlap themselves
        docs[i] = "\n".join(rng.choice(["p", "p q", "p q r s", "p q r s t u v", one, ""], int(rng.integers(1, 25))))
    docs[60] = "\n".join(["p q r"] * 30)
    rows = linededup.drop_repeated_lines(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    found = {r["doc_id"]: {n for s in r["runs"] for n in range(s["start"], s["end"])} for r in rows}
    assert found[2] == {1, 3} and found[3] == {0, 1}
    assert found == longest_runs(docs)


def test_line_dedup(spark, sample):
    docs = texts(sample)
    found = {r["doc_id"]: r for r in QUERIES["op3_line_dedup"](spark, SF).collect()}
    for i, gone in longest_runs(docs).items():
        kept = "\n".join(x for n, x in enumerate((docs[i] or "").split("\n")) if n not in gone)
        assert (found[i]["n_removed"], found[i]["kept_sha256"]) == (len(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_scores(spark, sample):
    found, docs = {r["doc_id"]: r for r in QUERIES["op4_attention_scores"](spark, SF).collect()}, texts(sample)
    tokens = {i: [*lower(t).split(), b" end"] for i, t in docs.items()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    c = collections.Counter(x for i, w in tokens.items() if not out[i] for x in w)
    n, v = sum(c.values()), len(c)
    for i, w in tokens.items():
        r = found[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[i], len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
    held = [r for r in found.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_attention_sums_to_one_and_gradients():
    stream = np.array([9, 1, 2, 3, 1, 2, 9, 9, 4, 9])
    model = lm.fresh(stream, 64)
    inputs = np.tile(np.array([[9, 1, 2, 3]]), (2, 1))
    logits, _ = model.forward(inputs)
    p = np.exp(logits) / np.exp(logits).sum(axis=2, keepdims=True)
    lm.with_emission(model, np.arange(64.0))
    share = np.exp(model.emission.astype(float))
    assert sum(share[k] * p[0, 1, model.class_of[k]] for k in range(64)) == pytest.approx(1, abs=1e-5)
    changed = inputs.copy()
    changed[:, 3] = 4
    assert np.allclose(model.forward(changed)[0][:, :3], logits[:, :3], atol=1e-6)  # causal
    targets, valid = np.tile(np.array([[1, 2, 3, 1]]), (2, 1)), np.ones((2, 4), bool)

    def loss():
        z, _ = model.forward(inputs)
        z = z.astype(float)
        z -= np.log(np.exp(z).sum(axis=2, keepdims=True))
        return -np.take_along_axis(z, model.class_of[targets][..., None], 2).mean()

    grads = model.gradients(inputs, targets, valid)
    for name in lm.PARTS:
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        array = getattr(model, name)
        old = array[at]
        array[at] = old + 1e-2
        up = loss()
        array[at] = old - 1e-2
        down = loss()
        array[at] = old
        assert (up - down) / 2e-2 == pytest.approx(grads[name][at], rel=0.05, abs=1e-5), name


def test_encoded_segments_are_the_subwords(spark, sample):
    docs = sample.withColumn("held_out", lm.held_out(F.col("doc_id"))).limit(60).coalesce(1)
    want = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = lm.encode_segments(docs, VOCABULARY, 25).toArrow()
    assert rows.num_rows == 3
    for at in range(rows.num_rows):
        ids = rows.column("doc_id")[at].as_py()
        sub, out = lm.decoded(rows, at)
        plain = lm.subwords(pa.table({"text": pa.array([want.pop(i) for i in ids], pa.string())}), VOCABULARY)
        assert all(np.array_equal(getattr(sub, n), getattr(plain, n)) for n in ("hashes", "number", "bounds", "ids", "firsts"))
        assert out.tolist() == [zlib.crc32(str(i).encode()) % 7 == 2 for i in ids]
        whole, starts = lm.training_streams(rows, at, 7)
        parts, bounds = lm.streams(plain, 7)
        assert np.array_equal(whole, np.concatenate([parts[bounds[d]:bounds[d + 1]] for d in range(len(ids)) if not out[d]])) and len(starts) == (~out).sum() + 1
    assert not want


def test_settled_model_gives_the_same_logits():
    model = lm.fresh(np.arange(50) % 9, 64)
    inputs = np.random.default_rng(1).integers(0, 64, (5, lm.CONTEXT))
    assert np.allclose(model.forward(inputs, 3)[0], model.settled().forward(inputs, 3)[0], atol=1e-5)


def test_windows_score_each_place_once():
    starts = np.cumsum([0, 2, 33, 34, 90, 3])
    begin, end, doc = lm.window_starts(starts)
    seen = collections.Counter()
    for b, e, d in zip(begin, end, doc):
        skip = 0 if b == starts[d] else lm.OVERLAP
        seen.update(range(b + skip, min(b + lm.CONTEXT, e)))
    assert seen == collections.Counter(p for d in range(5) for p in range(starts[d], starts[d + 1] - 1))


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 2, 8, 100, 1000])
def test_jump_hash(spark, n):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *[k * 0x1E3779B97F4A7C1 for k in range(60)]]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", jump_hash(F.col("k"), n).alias("s")).collect()
    assert all(r["s"] == jump(r["k"] & (2**64 - 1), n) for r in rows)


def test_shards(spark, sample):
    rows, docs = QUERIES["op5_jump_sharding"](spark, SF).collect(), texts(sample)
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert all(r["text_crc32"] == zlib.crc32(docs[r["doc_id"]].encode()) and r["size"] == len(docs[r["doc_id"]].encode()) + 1 for r in rows)
    assert all(r["grown_shard"] in (r["shard"], 8) for r in rows) and len(rows) == len(docs)


def test_packing(spark, sample):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(vocabulary_path(VOCABULARY))
    docs, rows = texts(sample), QUERIES["op6_best_fit_packing"](spark, SF).collect()
    ids = {i: [*slow.encode(t, add_special_tokens=False).ids, 0] for i, t in docs.items()}
    sequences, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        own = np.array(ids[r["doc_id"]][r["start"]:r["start"] + r["length"]], "<u4")
        assert r["ids_crc32"] == zlib.crc32(own.tobytes()) and len(own) == r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        places[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
    for i, own in ids.items():
        own_places = sorted(places[i])
        assert [p[0] for p in own_places] == list(range(-(-len(own) // 2048))) and sum(p[2] for p in own_places) == len(own)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= math.ceil(sum(map(len, ids.values())) / 2048) * 1.01 + 1


def test_encoder_is_the_tokenizer():
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(vocabulary_path(VOCABULARY)), encoder(VOCABULARY)
    for text in ["", " ", "a  b\n\n c's don't\tx '", "é½² 12ab   z  ", "<|endoftext|> x", "   x", "日本語 text"]:
        assert list(fast(text)) == slow.encode(text, add_special_tokens=False).ids


def test_neighbours(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = collections.defaultdict(dict)
    for r in QUERIES["op7_projected_neighbours"](spark, SF).collect():
        found[r["query_id"]][r["rank"]] = r
    hits = 0
    for k in np.flatnonzero(ids % 50 == 0):
        s = x @ x[k]
        s[k] = -9
        best = set(ids[np.lexsort((ids, -s))[:5]].tolist())
        own = found[int(ids[k])]
        assert sorted(own) == [1, 2, 3, 4, 5]
        assert all(own[r]["score"] == pytest.approx(float(s[np.flatnonzero(ids == own[r]["vec_id"])[0]]), abs=1e-12) for r in own)
        hits += len(best & {r["vec_id"] for r in own.values()})
    assert hits >= 0.9 * 5 * len(found)


def test_languages(spark, sample):
    lang = {r["doc_id"]: r["lang"] for r in sample.collect()}
    rows = QUERIES["op10_string_kernel_language"](spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_licences(spark, sample):
    lines = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "This work is licensed under the GNU General Public License, version 3.": "gpl",
             "Licensed under the Apache License, Version 2.0.": "apache", "Released under the MIT License.": "mit", "All rights reserved.": "reserved"}
    rows = {r["doc_id"]: r for r in QUERIES["op9_license_scan"](spark, SF).collect()}
    for i, text in texts(sample).items():
        want = [(str(n), lines[x]) for n, x in enumerate(text.split("\n")) if x in lines]
        assert rows[i]["families"] == ",".join(sorted({f for _, f in want})) and rows[i]["paragraphs"] == ",".join(n for n, _ in want)


def test_pipeline(spark, sample):
    docs, ids = sample, lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stored(stage(spark, docs, SF))
        if name == "line_dedup":
            assert len(ids(docs)) > len(ids(out)) and out.filter("n_chars <> length(text)").isEmpty()
        if name == "near_dedup":
            assert ids(out) == ids(neardup.near_duplicates(docs).filter("doc_id = class_id"))
        if name == "decontamination":
            items = spark.read.parquet(f"{SF}/benchmark.parquet")
            assert ids(docs) - ids(out) == ids(contamination(docs, items).filter(is_contaminated()))
        if name == "packing":
            assert ids(out) == ids(docs)
        docs = out


def test_large_buckets_make_no_rows_of_pairs(spark, monkeypatch):
    """Near copies that lie too far apart to be linked all meet in one bucket; blocks of them are compared inside tasks, and no link is lost."""
    rng = np.random.default_rng(4)
    base, fresh = rng.integers(1, 2**62, 150, dtype=np.uint64), iter(range(2**62, 2**62 + 10**6))
    rows, sets = [], []
    for i in range(90):
        own = set(sets[-1]) if i % 3 == 2 else set(base.tolist())
        for x in rng.permutation(sorted(own))[:8 if i % 3 == 2 else rng.integers(20, 50)].tolist():
            own.remove(x)
            own.add(next(fresh))
        sets.append(own)
        hashes = np.array(sorted(own), "<u8")
        rows.append((i, hashes.tobytes(), np.ones(len(own), "<f4").tobytes(), [7, 8 + i % 2], float(len(own)), float(len(own))))
    vecs = spark.createDataFrame(rows, neardup.VECTOR)
    root = list(range(90))
    for i in range(90):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    want = {frozenset(i for i in range(90) if root[i] == r) for r in set(root)}
    assert 20 < len(want) < 80
    sent = []
    plain = neardup.verify
    monkeypatch.setattr(neardup, "verify", lambda pairs, content: sent.append(pairs.count()) or plain(pairs, content))
    for size in (500, 16):
        monkeypatch.setattr(neardup, "GROUP_ROWS", size)
        monkeypatch.setattr(neardup, "MEETINGS", 100 * size)
        sent.clear()
        names = {r["digest"]: r["component"] for r in neardup.linked_texts(vecs).collect()}
        groups: dict[int, set[int]] = {}
        for i in range(90):
            groups.setdefault(names.get(i, -1 - i), set()).add(i)
        assert {frozenset(g) for g in groups.values()} == want
        assert sum(sent) <= 3 * 90  # members beside a pivot, not pairs of members


def test_answers_are_counts_in_the_order_of_the_message(spark, sample):
    """No hashes come back: the answers of the buckets, one after the other, are the counts of a segment's sorted words."""
    docs = sample.withColumn("held_out", lm.held_out(F.col("doc_id"))).limit(60).coalesce(1)
    encoded = lm.encode_segments(docs, VOCABULARY, 25).toArrow()
    sent = pa.Table.from_batches(lm._sender(VOCABULARY, 3)(encoded.to_batches()))
    told = [lm._count(sent.filter(pa.compute.equal(sent.column("bucket"), b))) for b in range(3)]
    total = collections.Counter()
    subs = [lm.decoded(encoded, at) for at in range(encoded.num_rows)]
    for sub, out in subs:
        total.update(sub.hashes[sub.number[np.repeat(~out, sub.counts)]].tolist())
    for segment, (sub, _) in zip(encoded.column("segment").to_pylist(), subs):
        parts = [lm._unplaned(c) for t in told for s, c in zip(t.column("segment").to_pylist(), t.column("counts").to_pylist()) if s == segment]
        assert np.concatenate(parts).tolist() == [total[h] for h in sub.hashes.tolist()]
    assert sum(t.column("ids").null_count for t in told) == sum(t.num_rows for t in told)
    assert sum(sum(t.column("tokens").to_pylist()) for t in told) == sum(total.values())


def test_slices_of_a_batch_give_the_same_gradients(monkeypatch):
    rng = np.random.default_rng(2)
    model = lm.fresh(rng.integers(0, 60, 900), 64)
    inputs, targets, valid = rng.integers(0, 64, (9, lm.CONTEXT)), rng.integers(0, 64, (9, lm.CONTEXT)), rng.random((9, lm.CONTEXT)) < 0.8
    whole = model.gradients(inputs, targets, valid)
    monkeypatch.setattr(lm, "SLICE_WINDOWS", 2)
    parts = model.gradients(inputs, targets, valid)
    assert all(np.allclose(whole[n], parts[n], atol=1e-6) for n in lm.PARTS)


def plain_gradients(m, inputs, targets, valid):
    """Attention written out, each product by itself: logits, and the gradients of the mean loss."""
    rows, k, turn = m.row_of[inputs], m.class_of[targets], (0, 2, 1)
    x = m.embed[rows] + m.place[:inputs.shape[1]]
    query, key, value = x @ m.q, x @ m.k, x @ m.v
    s = np.exp(query @ key.transpose(turn) * np.float32(lm.WIDTH**-0.5)) * lm.MASK[:inputs.shape[1], :inputs.shape[1]]
    s = s / s.sum(axis=2, keepdims=True)
    mixed = s @ value
    h = x + mixed @ m.o
    logits = h @ m.out + m.bias
    d = np.exp(logits)
    d = d / d.sum(axis=2, keepdims=True)
    d[np.arange(len(k))[:, None], np.arange(k.shape[1]), k] -= 1
    d = d * (valid / np.float32(valid.sum()))[..., None].astype(np.float32)
    flat = lambda a: a.reshape(-1, a.shape[-1])
    dh = d @ m.out.T
    dmixed = dh @ m.o.T
    ds = dmixed @ value.transpose(turn)
    ds = s * (ds - (ds * s).sum(axis=2, keepdims=True)) * np.float32(lm.WIDTH**-0.5)
    dquery, dkey, dvalue = ds @ key, ds.transpose(turn) @ query, s.transpose(turn) @ dmixed
    dx = dh + dquery @ m.q.T + dkey @ m.k.T + dvalue @ m.v.T
    embed = np.zeros_like(m.embed)
    np.add.at(embed, rows, dx)
    return logits, {"out": flat(h).T @ flat(d), "bias": flat(d).sum(axis=0), "o": flat(mixed).T @ flat(dh), "q": flat(x).T @ flat(dquery), "k": flat(x).T @ flat(dkey),
                    "v": flat(x).T @ flat(dvalue), "place": dx.sum(axis=0), "embed": embed}


def test_attention_equals_the_plain_form_in_less_time():
    rng = np.random.default_rng(4)
    model = lm.fresh(rng.integers(0, 5000, 60000), 6000)
    for name in lm.PARTS:  # larger weights, so that no part of the gradients is near 0
        getattr(model, name)[...] += rng.normal(0, 0.2, getattr(model, name).shape)
    inputs, targets = rng.integers(0, 6000, (2, lm.BATCH_WINDOWS, lm.CONTEXT))
    valid = rng.random(inputs.shape) < 0.9
    (logits, want), found = plain_gradients(model, inputs, targets, valid), model.gradients(inputs, targets, valid)
    assert np.allclose(logits, model.forward(inputs)[0], atol=1e-4) and set(found) == set(want) == set(lm.PARTS)
    for name in lm.PARTS:
        assert np.allclose(found[name], want[name], rtol=1e-3, atol=1e-5 * np.abs(want[name]).max() + 1e-7), name

    def seconds(work):
        began = time.process_time()
        work(model, inputs, targets, valid)
        return time.process_time() - began

    pairs = [(seconds(lm.Model.gradients), seconds(plain_gradients)) for _ in range(9)]
    assert min(a for a, _ in pairs) < 0.7 * min(b for _, b in pairs)


def test_known_words_are_encoded_once(monkeypatch):
    texts = [["one two one", None, "", "three  four <|endoftext|>x"], ["two five", "four one "], ["five two"], []]
    tables, encode, sent = [pa.table({"text": pa.array(t, pa.string())}) for t in texts], encoder(VOCABULARY), []
    monkeypatch.setattr(lm, "encoder", lambda _: lambda text: (sent.append(text), encode(text))[1])
    known = lm.Known.none()
    for table in tables:
        found = lm.subwords(table, VOCABULARY, known)
        n = len(sent)
        plain = lm.subwords(table, VOCABULARY)
        del sent[n:]
        assert all(np.array_equal(getattr(found, a), getattr(plain, a)) for a in ("hashes", "number", "bounds", "ids", "firsts"))
        for k, h in enumerate(found.hashes):
            word = next(w for t in table.column("text").to_pylist() for w in lower(t).split() if Words(pa.array([w.decode()]), np.ones(256, bool)).hashes()[0] == h)
            assert found.ids[found.firsts[k]:found.firsts[k + 1]].tolist() == encode(" " + word.decode()).tolist()
    words = " ".join(sent).split(" ")
    assert words.count("two") == words.count("five") == words.count("one") == 1


def test_first_texts_are_the_least_rows_and_few_reach_the_driver(spark, monkeypatch):
    """The driver gets as many texts as are asked for, and not as many from each task; ids that are shared or missing change nothing."""
    rows = [(None if i % 97 == 0 else i // 3, f"{i * 7919 % 1000:04d} " + "word " * 400) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(12).localCheckpoint()
    monkeypatch.setattr(lm, "SAMPLE_DOCS", 150)
    draw = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64(F.lit("lm"), "doc_id").alias("h")).distinct().collect()}
    want = [t for _, t in sorted(rows, key=lambda r: (draw[r[0]], r[0] is not None, r[0] or 0, r[1]))[:150]]
    same_id = docs.withColumn("doc_id", F.lit(None).cast("long"))
    conf = spark.sparkContext._jsc.sc().conf()
    conf.set("spark.driver.maxResultSize", "1m")  # 12 tasks with 150 texts each have 3.6 MB
    try:
        assert lm.first_texts(docs) == want
        assert lm.first_texts(same_id) == sorted(t for _, t in rows)[:150]
        assert lm.first_texts(docs.limit(0)) == []
    finally:
        conf.remove("spark.driver.maxResultSize")


def test_stored_segments_are_short_and_read_in_small_groups(spark):
    """A segment's row has its bytes compressed, and a task that makes many segments doesn't write them, nor read them, all at once."""
    rng = np.random.default_rng(6)
    words = np.array([f"w{i}" for i in range(20000)])
    docs = spark.createDataFrame([(i, " ".join(words[rng.integers(0, 20000, 3000)])) for i in range(300)], "doc_id long, text string").withColumn("held_out", F.lit(False)).coalesce(1)
    encoded = lm.stored(lm.encode_segments(docs, VOCABULARY, 10), **{**lm.GROUPS, "parquet.block.size": 300_000})
    files = [pq.ParquetFile(f.removeprefix("file://").removeprefix("file:")) for f in encoded.inputFiles()]
    groups = [f.metadata.row_group(k) for f in files for k in range(f.metadata.num_row_groups)]
    assert sum(g.num_rows for g in groups) >= 30 and max(g.num_rows for g in groups) <= 4
    for row in encoded.collect():
        sub, _ = lm.decoded(pa.Table.from_pylist([row.asDict()]), 0)
        assert sum(len(row[n]) for n in ("hashes", "number", "bounds", "ids", "sizes")) < 0.6 * (4 * (len(sub.number) + len(sub.ids) + len(sub.hashes)) + 8 * (len(sub.hashes) + len(sub.bounds)))


def test_pairs_of_parts_add_up(monkeypatch):
    rng = np.random.default_rng(8)
    lengths = [2, 2, 40, 3, 700, 2, 90, 5]
    starts = np.cumsum([0, *lengths])
    stream, column = rng.integers(0, 50, starts[-1]), lm.columns(rng.integers(1, 99, 50))
    keys, n = lm.pairs_of(stream, starts, column)
    for places, held in ((1, 4), (2, 50), (7, 3), (41, 200), (1000, 10**6)):
        monkeypatch.setattr(lm, "PAIR_PLACES", places)
        monkeypatch.setattr(lm, "PAIRS_HELD", held)
        pieces, total = [*lm.added_pairs(lm.pairs_in_parts(stream, starts, column))], collections.Counter()
        assert all((np.diff(k) > 0).all() and len(k) <= held + len(column) * 2 for k, _ in pieces)
        for k, m in pieces:
            total.update(dict(zip(k.tolist(), m.tolist())))
        assert total == dict(zip(keys.tolist(), n.tolist()))
    monkeypatch.setattr(lm, "PAIR_PLACES", 1 << 18)
    assert [*lm.added_pairs(lm.pairs_in_parts(np.zeros(0, np.int64), np.zeros(1, np.int64), column))] == []


def test_scores_read_row_groups_in_pieces(spark, sample, monkeypatch):
    """A vectored read would keep a buffer of a whole column of a row group outside the heap."""
    seen = []
    monkeypatch.setattr(lm, "score_documents", lambda docs: seen.append(docs) or docs)
    QUERIES["op4_attention_scores"](spark, SF)
    options = seen[0]._jdf.queryExecution().analyzed().collectLeaves().head().relation().options()
    assert options.get("parquet.hadoop.vectored.io.enabled").get() == "false"
    assert sorted(r["doc_id"] for r in seen[0].collect()) == sorted(texts(sample))


def test_texts_are_sent_in_small_batches(spark, monkeypatch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    monkeypatch.setattr(lm, "SENT_ROWS", 30)
    docs, before = spark.range(0, 200, 1, 1), spark.conf.get(name)
    sizes = lambda: [r["n"] for r in docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()]
    with lm.small_batches(spark):
        assert max(sizes()) == 30
    assert sizes() == [200] and spark.conf.get(name) == before
    spark.conf.set(name, "20")
    try:
        with pytest.raises(ValueError), lm.small_batches(spark):
            assert max(sizes()) == 20
            raise ValueError
        assert spark.conf.get(name) == "20"
    finally:
        spark.conf.unset(name)
