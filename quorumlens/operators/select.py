"""Candidate scoring, selection, controls and alignment of outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dist as D
from ..functions import ranking
from ..functions import text as X
from ..functions.keys import hash60
from . import metrics as M


def candidate_scores(cands: DataFrame, pred: str, gold: str, control: str) -> DataFrame:
    """K1: CE and KL of a candidate's distribution against gold and control; scores are the negated CE."""
    n = cands.withColumns({c: D.normalized(F.col(c)) for c in (pred, gold, control)})
    p = F.col(pred)
    return n.withColumns({
        "gold_ce": D.soft_cross_entropy(F.col(gold), p), "gold_kl": D.kl_divergence(F.col(gold), p),
        "control_ce": D.soft_cross_entropy(F.col(control), p), "control_kl": D.kl_divergence(F.col(control), p),
    }).withColumns({"gold_score": -F.col("gold_ce"), "control_score": -F.col("control_ce")})


SELECTIONS = ["first", "best_control", "best_gold"]


def best_of_n(cands: DataFrame, keys: Sequence[str], index: str, carry: Sequence[str]) -> DataFrame:
    """K2: per example the first candidate and the best by control and by gold score, lowest index on ties.

    Arg-min aggregates combine before the shuffle, so no candidate list is built.
    """
    row = F.struct(F.col(index).alias("selected_index"), *carry)
    first = F.min_by(row, F.col(index))
    by = lambda s: F.max_by(row, F.struct(F.round(s, 12), -F.col(index)))
    agg = cands.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("candidates"),
        F.array(
            F.struct(F.lit("first").alias("selection"), first.alias("row")),
            F.struct(F.lit("best_control").alias("selection"), by("control_score").alias("row")),
            F.struct(F.lit("best_gold").alias("selection"), by("gold_score").alias("row")),
        ).alias("_s"),
    )
    return agg.select(*keys, "candidates", F.explode("_s").alias("s")).select(*keys, "candidates", "s.selection", "s.row.*")


def pool_metrics(cands: DataFrame, groups: Sequence[str], example: str, index: str) -> DataFrame:
    """K3: mean first and best CE, their gain, and the mean pool size."""
    per = cands.groupBy(*groups, example).agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("control_ce", index).alias("fc"), F.min("control_ce").alias("bc"),
        F.min_by("gold_ce", index).alias("fg"), F.min("gold_ce").alias("bg"),
    )
    return per.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("examples"), F.avg("n").alias("mean_candidates"),
        F.avg("fc").alias("first_control_ce"), F.avg("bc").alias("best_control_ce"),
        (F.avg("fc") - F.avg("bc")).alias("control_gain"),
        F.avg("fg").alias("first_gold_ce"), F.avg("bg").alias("best_gold_ce"), (F.avg("fg") - F.avg("bg")).alias("gold_gain"),
    )


def selection_metrics(selected: DataFrame, groups: Sequence[str], classes: int) -> DataFrame:
    """K4: metric block against gold, mean selected index, and the histogram of the predicted class."""
    rows = M.row_metrics(selected)
    block = M.metric_block(rows, groups, classes)
    hist = [F.sum((F.col("yhat") == k).cast("long")) for k in range(classes)]
    extra = rows.groupBy(*groups).agg(F.avg("selected_index").alias("mean_index"), F.array(*hist).alias("histogram"))
    return block.join(extra, list(groups))


def shifted_partner(rows: DataFrame, ids: Sequence[str], carry: Sequence[str], seed: object = 0) -> DataFrame:
    """K5: every row gets the `carry` columns of another row: its successor in a seeded order, the last row the
    first.  A cyclic shift has no fixed point for more than one row.  Joined on the position, so no window spans
    the table."""
    placed = ranking.hash_positions(rows, [], seed, ids, "_pos")
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    partner = placed.select(F.col("_pos").alias("_to"), *[F.col(c).alias("partner_" + c) for c in (*ids, *carry)])
    target = placed.crossJoin(F.broadcast(n)).withColumn("_to", (F.col("_pos") + 1) % F.col("_n"))  # one-row side
    return target.join(partner, "_to").drop("_to", "_pos", "_n")


def control_table(gold: DataFrame, predicted: DataFrame, ids: Sequence[str], dist: str, seed: object = 0) -> DataFrame:
    """K5: gold, predicted, zero and shuffled control per row, aligned on the key columns.

    Rows without a prediction keep a null predicted control; `quality.alignment_errors` lists them.
    """
    p = predicted.select(*ids, F.col(dist).alias("_p"))
    joined = shifted_partner(gold.select(*ids, dist), ids, [dist], seed).join(p, list(ids), "left")
    arms = F.array(
        F.struct(F.lit("gold").alias("control"), F.col(dist).alias("dist")),
        F.struct(F.lit("predicted").alias("control"), F.col("_p").alias("dist")),
        F.struct(F.lit("zero").alias("control"), F.lit(None).cast("array<double>").alias("dist")),
        F.struct(F.lit("shuffled").alias("control"), F.col(f"partner_{dist}").alias("dist")),
    )
    partner = [F.col(f"partner_{c}") for c in ids]
    return joined.select(*ids, *partner, F.explode(arms).alias("a")).select(*ids, *[f"partner_{c}" for c in ids], "a.control", "a.dist")


def row_subset(rows: DataFrame, n: int, ids: Sequence[str], strategy: str = "first", seed: object = 0) -> DataFrame:
    """K6: the first n rows in key order, or n rows in a seeded order (a sampling operator)."""
    if strategy == "first":
        return rows.orderBy(*ids).limit(n)
    return rows.withColumn("_h", hash60(F.lit(str(seed)), *[F.col(c) for c in ids])).orderBy("_h", *ids).limit(n).drop("_h")


def context_filter(rows: DataFrame, dist: str, classes: Sequence[int] | None, min_p: float, min_margin: float,
                   transitions: Sequence[str] | None = None) -> DataFrame:
    """K7: rows whose top region is allowed, likely enough, ahead of the second, and of an allowed transition."""
    s = F.sort_array(F.col(dist), asc=False)
    margin = F.when(F.size(s) > 1, F.element_at(s, 1) - F.element_at(s, 2)).otherwise(F.element_at(s, 1))
    out = rows.withColumns({"top": D.top_index(F.col(dist)), "top_p": F.element_at(s, 1), "margin": margin})
    out = out.filter((F.col("top_p") >= min_p) & (F.col("margin") >= min_margin))
    if classes is not None:
        out = out.filter(F.col("top").isin(list(classes)))
    return out if transitions is None else out.filter(F.col("transition").isin(list(transitions)))


def control_summary(rows: DataFrame, groups: Sequence[str], classes: int) -> DataFrame:
    """K8: per control region: hit rate, mean probability, CE against control and gold, words, histogram.

    rows: control_region, pred, gold, response.
    """
    p = D.normalized(F.col("pred"))
    one = D.normalized(D.one_hot(F.col("control_region"), classes))
    base = rows.withColumn("_p", p).withColumn("_t", D.top_index(F.col("_p")))
    return base.groupBy(*groups, "control_region").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("_t") == F.col("control_region")).cast("double")).alias("hit_rate"),
        F.avg(F.element_at("_p", (F.col("control_region") + 1).cast("int"))).alias("mean_p"),
        F.avg(D.soft_cross_entropy(one, F.col("_p"))).alias("control_ce"),
        F.avg((F.col("_t") == D.top_index(F.col("gold"))).cast("double")).alias("gold_accuracy"),
        F.avg(D.soft_cross_entropy(D.normalized(F.col("gold")), F.col("_p"))).alias("gold_ce"),
        F.avg(X.words_by_space(F.col("response"))).alias("mean_words"),
        F.array(*[F.sum((F.col("_t") == k).cast("long")) for k in range(classes)]).alias("histogram"),
    )


def control_contrast(rows: DataFrame, example: Sequence[str], controls: Sequence[int], focus: int | None = None) -> DataFrame:
    """K8: contexts that have every control: does the top region change, how many distinct, mean pairwise word
    Jaccard, and the probability lift of the focus control over the others.

    One array per control is kept as a column, so pairs of controls are expressions inside a row.
    """
    aggs = []
    for c in controls:
        here = F.col("control_region") == c
        aggs += [
            F.max(F.when(here, D.top_index(F.col("pred")))).alias(f"t{c}"),
            F.max(F.when(here, X.stripped_words(F.col("response")))).alias(f"w{c}"),
        ]
        if focus is not None:
            aggs.append(F.max(F.when(here, F.element_at("pred", focus + 1))).alias(f"p{c}"))
    per = rows.filter(F.col("control_region").isin(list(controls))).groupBy(*example).agg(
        F.countDistinct("control_region").alias("_n"), *aggs).filter(F.col("_n") == len(controls))
    pairs = [(a, b) for i, a in enumerate(controls) for b in controls[i + 1:]]
    total = sum((X.jaccard(F.col(f"w{a}"), F.col(f"w{b}"), 1.0) for a, b in pairs), F.lit(0.0))
    distinct = F.size(F.array_distinct(F.array(*[F.col(f"t{c}") for c in controls])))
    cols = [distinct.cast("long").alias("distinct_tops"), (distinct > 1).alias("top_changes"), (total / len(pairs)).alias("mean_jaccard")]
    if focus is not None:
        others = F.greatest(*[F.col(f"p{c}") for c in controls if c != focus], F.lit(float("-inf")))
        cols += [(F.col(f"t{focus}") == focus).alias("focus_hit"), (F.col(f"p{focus}") - others).alias("focus_lift")]
    return per.select(*example, *cols)


FLAGS = ["gold_top", "gate_active", "gated_top", "ungated_top"]


def target_flags(rows: DataFrame, k: int, min_gate: float | None = None) -> DataFrame:
    """K9: the four reasons a row may be selected.  rows: gold, ungated, gated, gate, gate_pred."""
    top = lambda c: D.top_index(F.col(c)) == k
    active = F.col("gate") >= min_gate if min_gate is not None else F.col("gate_pred") == 1
    return rows.withColumns({"gold_top": top("gold"), "gate_active": active, "gated_top": top("gated"), "ungated_top": top("ungated")})


def targeted(flagged: DataFrame, groups: Sequence[str], mode: str = "union") -> DataFrame:
    """K9: rows with any (union) or all (intersection) of the chosen reasons."""
    cond: Column = F.lit(mode == "intersection")
    for g in groups:
        cond = (cond & F.col(g)) if mode == "intersection" else (cond | F.col(g))
    return flagged.filter(cond)


def reason_counts(rows: DataFrame, stage: str, transition: str = "transition") -> DataFrame:
    """K9: counts by transition and reason, labelled with the stage (all, candidates, selected)."""
    return rows.groupBy(F.lit(stage).alias("stage"), F.col(transition).alias("transition")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f).cast("long")).alias("n_" + f) for f in FLAGS])


# ---- alignment ------------------------------------------------------------------------------------------------

METHODS = ["id", "id_prefix", "turn", "content"]


def canonical_index(examples: DataFrame) -> DataFrame:
    """Match keys of the canonical examples (example, conv_id, turn, content): one row per key, the last example
    of a key by `ord` wins."""
    keys = F.explode(F.array(
        F.concat(F.lit("i:"), "example"),
        F.concat(F.lit("t:"), F.col("conv_id").cast("string"), F.lit("|"), F.col("turn").cast("string")),
        F.concat(F.lit("c:"), "content"),
    )).alias("key")
    return examples.select("example", "ord", keys).filter("key is not null").groupBy("key").agg(F.max_by("example", "ord").alias("example"))


def align(outputs: DataFrame, index: DataFrame, separator: str = "_direct_") -> DataFrame:
    """Match outputs (row_id, example_ref, conv_id, turn, content) by id, id prefix, conversation and turn
    (same, +1, -1), then content.  All candidate keys with their priority meet the index in one equi-join, the
    best priority wins; unmatched rows keep a null example and the method `unmatched`."""
    turn_key = lambda d: F.concat(F.lit("t:"), F.col("conv_id").cast("string"), F.lit("|"), (F.col("turn") + d).cast("string"))
    head = F.when(F.contains("example_ref", F.lit(separator)), F.concat(F.lit("i:"), F.substring_index("example_ref", separator, 1)))
    cands = [
        (F.concat(F.lit("i:"), "example_ref"), "id"), (head, "id_prefix"), (turn_key(0), "turn"), (turn_key(1), "turn"),
        (turn_key(-1), "turn"), (F.concat(F.lit("c:"), "content"), "content"),
    ]
    arr = F.array(*[F.struct(F.lit(i).alias("rank"), k.alias("key"), F.lit(m).alias("method")) for i, (k, m) in enumerate(cands)])
    keyed = outputs.select("row_id", F.explode(arr).alias("k")).select("row_id", "k.*").filter("key is not null")
    hit = keyed.join(index, "key").groupBy("row_id").agg(F.min(F.struct("rank", "method", "example")).alias("h"))
    return outputs.join(hit, "row_id", "left").select(
        *outputs.columns, F.col("h.example").alias("example"), F.coalesce("h.method", F.lit("unmatched")).alias("method"))


def coverage(outputs: DataFrame, expected: DataFrame, system: str = "system", key: str = "example") -> DataFrame:
    """Generated, matched, missing, extra and duplicate ids per system, and whether coverage is exact."""
    per = outputs.groupBy(system, key).agg(F.count(F.lit(1)).alias("n"))
    want = expected.select(key).distinct()
    total = want.agg(F.count(F.lit(1)).alias("expected"))
    marked = per.join(want.withColumn("_e", F.lit(True)), key, "left")
    agg = marked.groupBy(system).agg(
        F.sum("n").alias("generated"), F.sum(F.col("_e").isNotNull().cast("long")).alias("matched"),
        F.sum(F.col("_e").isNull().cast("long")).alias("extra"), F.sum(F.col("n") - 1).alias("duplicates"))
    out = agg.crossJoin(F.broadcast(total)).withColumn("missing", F.col("expected") - F.col("matched"))  # one-row side
    ok = (F.col("generated") == F.col("expected")) & (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("duplicates") == 0)
    return out.withColumn("ok", ok)


def common_examples(frames: dict[str, DataFrame], key: str, value: str, order: str) -> DataFrame:
    """Inner join of several systems on the example key; the last row per key of each system counts."""
    out = None
    for name, df in frames.items():
        last = df.groupBy(key).agg(F.max_by(value, order).alias(name))
        out = last if out is None else out.join(last, key)
    return out


def control_variants(gold: DataFrame, gated: DataFrame, ungated: DataFrame, ids: Sequence[str], k: int, classes: int) -> DataFrame:
    """Gold, ungated (from the gated row when it carries one, else the ungated table), gated and forced
    control per row, with the place each came from."""
    g = gold.select(*ids, F.col("dist").alias("_gold"))
    a = gated.select(*ids, F.col("dist").alias("_gated"), F.col("ungated_dist").alias("_own"))
    u = ungated.select(*ids, F.col("dist").alias("_un"))
    j = g.join(a, list(ids)).join(u, list(ids), "left")
    own = F.col("_own").isNotNull()
    arm = lambda name, c, src: F.struct(F.lit(name).alias("control"), c.alias("dist"), src.alias("source"))
    arms = F.array(
        arm("gold", F.col("_gold"), F.lit("gold")),
        arm("ungated", F.coalesce("_own", "_un"), F.when(own, F.lit("gated_columns")).otherwise(F.lit("ungated_table"))),
        arm("gated", F.col("_gated"), F.lit("gated")),
        arm("forced", D.one_hot(F.lit(k), classes), F.lit("forced_region")),
    )
    return j.select(*ids, F.explode(arms).alias("a")).select(*ids, "a.*")


def artifact_status(aligned: DataFrame, expected: DataFrame, response: str = "response") -> DataFrame:
    """Per system: raw rows, matched examples (first match per example with a response), coverage, and the
    counts by match method; always a diagnostic."""
    n = expected.select("example").distinct().agg(F.count(F.lit(1)).alias("expected"))
    usable = F.col("example").isNotNull() & (F.trim(F.coalesce(response, F.lit(""))) != "")
    by = [F.sum((F.col("method") == m).cast("long")).alias("by_" + m) for m in [*METHODS, "unmatched"]]
    # Rows of one example are merged first, so a system with a third of all rows spreads over its examples.
    raw = aligned.groupBy("system").agg(F.count(F.lit(1)).alias("raw_rows"), *by)
    matched = aligned.filter(usable).groupBy("system", "example").agg(F.count(F.lit(1)).alias("_c")).groupBy("system").agg(
        F.count(F.lit(1)).alias("matched"))
    out = raw.join(matched, "system", "left").fillna(0, ["matched"]).crossJoin(F.broadcast(n))  # one-row side
    return out.withColumns({"coverage": F.when(F.col("expected") > 0, F.col("matched") / F.col("expected")).otherwise(0.0),
                            "diagnostic_only": F.lit(True)})


def first_matches(aligned: DataFrame, order: str) -> DataFrame:
    """The first matching row of each (system, example)."""
    return aligned.filter("example is not null").groupBy("system", "example").agg(
        F.min_by(F.struct(*[c for c in aligned.columns if c not in ("system", "example")]), order).alias("r")
    ).select("system", "example", "r.*")


def select_runs(rows: DataFrame, spec: DataFrame) -> DataFrame:
    """Rows of each run that match its specification.  spec: run, group_value, split, expected."""
    return rows.join(F.broadcast(spec.select("run", "group_value", "split")), ["run", "group_value", "split"])  # one row per run


def run_check(rows: DataFrame, spec: DataFrame) -> DataFrame:
    """Per specified run the row count, and whether it is missing or unexpected in size."""
    counts = select_runs(rows, spec).groupBy("run", "group_value", "split").agg(F.count(F.lit(1)).alias("n"))
    j = spec.join(counts, ["run", "group_value", "split"], "left").fillna(0, ["n"])
    state = F.when(F.col("n") == 0, "missing").when(F.col("n") != F.col("expected"), "wrong_count").otherwise("ok")
    return j.withColumn("state", state)
