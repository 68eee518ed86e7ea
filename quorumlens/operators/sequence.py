"""Windows over the turns of a conversation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranking
from ..functions.lineage import checkpointed
from ..functions.keys import role_pair

LAG1_PAIRS = ["A2B", "B2A"]
LAG2_PAIRS = ["A2A", "B2B"]


def next_turn_features(turns: DataFrame, keys: Sequence[str], pos: str = "turn", carry: Sequence[str] = ()) -> DataFrame:
    """Next role, role pair, lag-2 role pair, last-turn flag and the carried columns of the next turn.

    `pos` is the dense 0-based position inside the conversation.
    """
    cols = ["role", *carry]
    seen = ranking.ahead(turns, keys, pos, cols, (1, 2))
    plain = lambda n: F.when(n.isNotNull(), F.concat(F.col("role"), F.lit("2"), n))
    return seen.select(
        *turns.columns,
        F.col("next1.role").alias("next_role"),
        plain(F.col("next1.role")).alias("role_pair"),
        plain(F.col("next2.role")).alias("lag2_role_pair"),
        F.col("next1").isNull().alias("is_last_turn"),
        *[F.col(f"next1.{c}").alias("next_" + c) for c in carry],
    )


def running_context(turns: DataFrame, keys: Sequence[str], pos: str, entry: Column, until: int = 0) -> DataFrame:
    """Attach `history`, the entries of all turns up to `until` rows from the current one, in order.

    Every output row carries its whole history: that is the result asked for, so one conversation's rows
    are ordered together.  Nothing else in this library windows a conversation as a whole.
    """
    w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, until)
    return turns.withColumn("history", F.collect_list(entry).over(w))


def adjacent_pairs(turns: DataFrame, keys: Sequence[str], pos: str = "turn", cols: Sequence[str] = ("item", "role", "text")) -> DataFrame:
    """(turn, next turn, context up to this turn as `role: text` lines)."""
    line = F.concat(F.col("role"), F.lit(": "), F.col("text"))
    with_next = ranking.ahead(turns, keys, pos, cols, (1,))
    ctx = running_context(with_next, keys, pos, line).filter("next1 is not null")
    return ctx.select(
        *keys,
        pos,
        *[F.col(c) for c in cols],
        *[F.col(f"next1.{c}").alias("next_" + c) for c in cols],
        F.array_join("history", "\n").alias("context"),
    )


def prepared_pairs(pairs: DataFrame, item_space: DataFrame) -> DataFrame:
    """Adjacent pairs with region distribution, vector and entropy of both ends.

    `item_space` has item, dist, z, entropy.  Pair and space are joined on the item key, twice.
    """
    def side(prefix: str, key: str) -> DataFrame:
        return item_space.select(
            F.col("item").alias(key), *[F.col(c).alias(f"{prefix}_{c}") for c in ("dist", "z", "entropy")]
        )

    joined = pairs.join(side("source", "item"), "item").join(side("target", "next_item"), "next_item")
    return joined.withColumn("transition", F.concat("role", F.lit("->"), "next_role"))


def typed_pairs(turns: DataFrame, keys: Sequence[str], pos: str, cols: Sequence[str]) -> DataFrame:
    """Lag-1 pairs of type A2B/B2A and lag-2 pairs of type A2A/B2B, both lags from one window."""
    need = list(dict.fromkeys([*cols, "role"]))
    seen = ranking.ahead(turns.select(*keys, pos, *need), keys, pos, need, (1, 2))
    arms = F.explode(
        F.array(
            F.struct(F.lit(1).alias("lag"), F.col("next1").alias("t")),
            F.struct(F.lit(2).alias("lag"), F.col("next2").alias("t")),
        )
    ).alias("arm")
    both = seen.select(*keys, *need, arms)
    pair = role_pair(F.col("role"), F.col("arm.t.role"))
    typed = both.withColumn("pair", pair).filter(
        ((F.col("arm.lag") == 1) & F.col("pair").isin(LAG1_PAIRS))
        | ((F.col("arm.lag") == 2) & F.col("pair").isin(LAG2_PAIRS))
    )
    return typed.select(
        *keys,
        "pair",
        *[F.col(c).alias("s_" + c) for c in cols],
        *[F.col(f"arm.t.{c}").alias("t_" + c) for c in cols],
        F.col("arm.lag").alias("lag"),
    )


def prediction_instances(pairs: DataFrame, item_space: DataFrame, texts: DataFrame, situations: DataFrame | None = None) -> DataFrame:
    """A->B pairs with both distributions, texts and (where known) the situation of the conversation."""
    s = item_space.select(F.col("item").alias("s_item"), F.col("dist").alias("s_dist"))
    t = item_space.select(F.col("item").alias("t_item"), F.col("dist").alias("t_dist"))
    st = texts.select(F.col("item").alias("s_item"), F.col("text").alias("s_text"))
    tt = texts.select(F.col("item").alias("t_item"), F.col("text").alias("t_text"))
    out = (
        pairs.filter("pair = 'A2B'").join(s, "s_item").join(t, "t_item").join(st, "s_item", "left").join(tt, "t_item", "left")
    )
    if situations is not None:
        out = out.join(situations, ["split", "conv_id"], "left")
    return out


def context_candidates(turns: DataFrame, keys: Sequence[str], pos: str = "turn") -> DataFrame:
    """Turns with text and at least one earlier turn with text: earlier turns as an array, previous role,
    and the transition `prev->role` (`START->role` when nothing precedes)."""
    filled = F.trim(F.coalesce("text", F.lit(""))) != ""
    entry = F.when(filled, F.struct(F.col(pos).alias("turn"), "role", "text"))
    hist = running_context(turns, keys, pos, entry, -1)
    prev = F.when(F.size("history") > 0, F.element_at("history", -1)["role"])
    return (
        hist.filter(filled & (F.col(pos) >= 1) & (F.size("history") > 0))
        .withColumn("previous_role", prev)
        .withColumn("transition", F.concat(F.coalesce("previous_role", F.lit("START")), F.lit("->"), "role"))
    )


def response_examples(turns: DataFrame, keys: Sequence[str], pos: str = "turn") -> DataFrame:
    """Every B turn with non-empty history becomes (history array, reference)."""
    cand = context_candidates(turns, keys, pos).filter("role = 'B'")
    return cand.select("item", *keys, pos, "history", F.col("text").alias("reference"))


def merged_conversations(annotated: DataFrame, keys: Sequence[str], annotators: int, signature: Sequence[str]) -> DataFrame:
    """Per conversation the number of annotators, whether all annotated it, and whether the text they saw
    differs.  Each turn is compared by a digest, so no conversation is gathered anywhere.

    `annotated` has one row per (conversation, turn, annotator) with the signature columns.
    """
    digest = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in signature]), 256)
    per_turn = annotated.groupBy(*keys, "turn").agg(
        F.countDistinct("annotator").alias("_a"), F.countDistinct(digest).alias("_d")
    )
    seen = annotated.groupBy(*keys).agg(F.countDistinct("annotator").alias("n_annotators"))
    turn_level = per_turn.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_turns"), F.max("_d").alias("_max_d"), F.min("_a").alias("_min_a")
    )
    joined = seen.join(turn_level, list(keys))
    return joined.select(
        *keys,
        "n_annotators",
        "n_turns",
        (F.col("n_annotators") >= annotators).alias("complete"),
        ((F.col("_max_d") > 1) | (F.col("_min_a") < F.col("n_annotators"))).alias("mismatch"),
    )


def unknown_labels(votes: DataFrame, pool: DataFrame, label: str = "label") -> DataFrame:
    """Labels used by annotators that are not in the pool, with their counts."""
    return (
        votes.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
        .join(pool.select(label).distinct(), label, "left_anti")
    )


def first_by_content(rows: DataFrame, id_col: str, content: Sequence[str], order: str) -> DataFrame:
    """Going through the rows in `order`, keep a row unless a kept row has its id or its content key.

    A row that comes first for its id and for its content is kept; what shares either with it is dropped; the
    rest is looked at again.  Copies may be very many, so the firsts are partial-aggregated minima, never a
    window over the copies.  Almost always one round suffices, each round ends in a checkpoint.
    """
    key = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in content]), 256)
    ids = rows.select(F.col(id_col).alias("_id"), key.alias("_k"), F.col(order).alias("_o"))
    open_rows, kept = checkpointed(ids), None
    while True:
        by_id = open_rows.groupBy("_id").agg(F.min("_o").alias("_o"))
        by_key = open_rows.groupBy("_k").agg(F.min("_o").alias("_o"))
        winners = checkpointed(open_rows.join(by_id, ["_id", "_o"], "left_semi").join(by_key, ["_k", "_o"], "left_semi"))
        kept = winners if kept is None else kept.unionByName(winners)
        rest = open_rows.join(winners.select("_id"), "_id", "left_anti").join(winners.select("_k"), "_k", "left_anti")
        open_rows = checkpointed(rest)
        if open_rows.isEmpty():
            return rows.join(kept.select(F.col("_o").alias(order)), order, "left_semi")
