"""Deterministic sampling and assignment.

Random choices are ranks of seeded hashes: the same on any cluster and any partitioning.  Ranks come from
`functions.ranking`, so a stratum that holds a third of the data is not gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranking
from ..functions.keys import hash60
from ..functions.lineage import checkpointed


def entropy_tertiles(rows: DataFrame, entropy: str, ids: Sequence[str]) -> DataFrame:
    """A1: low, medium and high thirds in (entropy, ids) order; sizes differ by at most one, extras first.

    Half of all items may have entropy 0: the borders of the ranges are drawn over entropy and ids.
    """
    j = ranking.range_positions(rows, [], [entropy, *ids], "_pos", "_n")
    base, extra = F.floor(F.col("_n") / 3), F.col("_n") % 3
    first = base + F.when(extra > 0, 1).otherwise(0)
    second = first + base + F.when(extra > 1, 1).otherwise(0)
    name = F.when(F.col("_pos") < first, "low").when(F.col("_pos") < second, "medium").otherwise("high")
    return j.withColumn("stratum", name).drop("_pos", "_n")


def largest_remainder(counts: DataFrame, key: str, n: int, count: str = "n") -> DataFrame:
    """A2: integer quotas that sum to n; leftovers by remainder, then size, then key.  One row per stratum."""
    every = Window.partitionBy()  # strata only
    raw = F.col(count) * F.lit(n) / F.sum(count).over(every)
    base = counts.withColumn("_raw", raw).withColumn("_q", F.floor("_raw").cast("long"))
    order = Window.orderBy(F.desc(F.round(F.col("_raw") - F.col("_q"), 12)), F.desc(count), F.asc(key))
    left = F.lit(n) - F.sum("_q").over(every)
    ranked = base.withColumns({"_left": left, "_r": F.row_number().over(order)})
    return ranked.select(key, F.col(count), (F.col("_q") + F.when(F.col("_r") <= F.col("_left"), 1).otherwise(0)).alias("quota"))


def common_ids(records: DataFrame, annotators: int, keys: Sequence[str]) -> DataFrame:
    """A3: keys that every annotator has."""
    return records.groupBy(*keys).agg(F.countDistinct("annotator").alias("_a")).filter(F.col("_a") >= annotators).select(*keys)


def stratified(rows: DataFrame, stratum: str, ids: Sequence[str], quotas: DataFrame, seed: object = 0) -> DataFrame:
    """Per stratum the first `quota` rows in seeded order.  quotas: one row per stratum."""
    placed = ranking.hash_positions(rows, [stratum], seed, ids, "_pos")
    return placed.join(F.broadcast(quotas.select(stratum, "quota")), stratum).filter("_pos < quota").drop("_pos", "quota")


def annotator_slots(rows: DataFrame, ids: Sequence[str], annotators: Sequence[str], seed: object = 0) -> DataFrame:
    """A4: rows spread evenly over annotators in seeded order; the first annotators take the remainder."""
    placed = ranking.hash_positions(rows, [], seed, ids, "_pos")
    names = F.array(*[F.lit(a) for a in annotators])
    return placed.withColumn("slot", F.element_at(names, (F.col("_pos") % len(annotators) + 1).cast("int"))).drop("_pos")


def one_per_conversation(rows: DataFrame, conv: str, ids: Sequence[str], seed: object = 0) -> DataFrame:
    """One row per conversation, the smallest seeded hash; an aggregate, so a long conversation is no burden."""
    h = F.struct(hash60(F.lit(str(seed)), *[F.col(c) for c in ids]), *ids)
    keep = [c for c in rows.columns if c != conv]
    return rows.groupBy(conv).agg(F.min_by(F.struct(*keep), h).alias("r")).select(conv, "r.*")


def diverse_sample(rows: DataFrame, stratum: str, facets: Sequence[str], conv: str, ids: Sequence[str], per_stratum: int, seed: object = 0) -> DataFrame:
    """A5, as a closed form: one row per conversation, then rows take turns over the facets.

    Inside the finest cell rows are ranked by hash; each coarser level ranks by (rank below, hash), so every
    facet value comes up once before any comes up twice.  The first `per_stratum` of each stratum are the sample.
    """
    one = one_per_conversation(rows, conv, ids, seed).withColumn("_h", hash60(F.lit(str(seed)), *[F.col(c) for c in ids]))
    levels = [[stratum, *facets[:i]] for i in range(len(facets), -1, -1)]
    ranked = ranking.positions(checkpointed(one), levels[0], ["_h", *ids], F.shiftright("_h", 48), "_r")
    for level in levels[1:]:
        # At most one row per cell below shares a rank, so blocks of 64 ranks stay small.
        ranked = ranking.positions(checkpointed(ranked), level, ["_r", "_h", *ids], F.floor(F.col("_r") / 64), "_next")
        ranked = ranked.drop("_r").withColumnRenamed("_next", "_r")
    return ranked.filter(F.col("_r") < per_stratum).drop("_r", "_h")


def round_robin(rows: DataFrame, excluded: DataFrame, conv: str, stratum: str, ids: Sequence[str], n: int, seed: object = 0) -> DataFrame:
    """Leave out used conversations if enough rows remain, then cycle through the strata."""
    free = rows.join(excluded.select(conv).distinct(), conv, "left_anti")
    pool = free if free.limit(n).count() >= n else rows
    placed = ranking.hash_positions(pool, [stratum], seed, ids, "_pos")
    return placed.orderBy("_pos", stratum).limit(n).drop("_pos")


def pairwise_items(contexts: DataFrame, comparisons: Sequence[str]) -> DataFrame:
    """Every context with every comparison (an explode over the short list)."""
    return contexts.withColumn("comparison", F.explode(F.array(*[F.lit(c) for c in comparisons])))


def assign_raters(items: DataFrame, context: str, comparisons: Sequence[str], raters: int, per_item: int) -> DataFrame:
    """A8, as a rotation: context number c holds out rater c mod n; its comparison j takes the raters
    c + 1 + j * per_item + s.  No rater meets a context twice while comparisons * per_item < raters."""
    if len(comparisons) * per_item >= raters:
        raise ValueError("a context would need more raters than there are")
    order = ranking.hash_positions(items.select(context).distinct(), [], "contexts", [context], "_c")
    j = F.array_position(F.array(*[F.lit(c) for c in comparisons]), F.col("comparison")) - 1
    slots = F.explode(F.sequence(F.lit(0), F.lit(per_item - 1))).alias("_s")
    spread = items.join(order, context).select("*", slots)
    rater = (F.col("_c") + 1 + j * per_item + F.col("_s")) % raters
    return spread.withColumns({"rater": rater.cast("long"), "held_out": (F.col("_c") % raters).cast("long")}).drop("_c", "_s")


def balance_sides(assigned: DataFrame, ids: Sequence[str], seed: object = 0) -> DataFrame:
    """Exactly half (rounded down) of each comparison has the main system on side A."""
    placed = ranking.hash_positions(assigned, ["comparison"], seed, ids, "_pos")
    n = assigned.groupBy("comparison").agg(F.count(F.lit(1)).alias("_n"))
    j = placed.join(F.broadcast(n), "comparison")  # one row per comparison
    return j.withColumn("main_on_a", F.col("_pos") < F.floor(F.col("_n") / 2)).drop("_pos", "_n")


def conversation_sample(rows: DataFrame, conv: str, ids: Sequence[str], n: int, seed: object = 0) -> DataFrame:
    """A10: n conversations with one row each."""
    one = one_per_conversation(rows, conv, ids, seed)
    return one.withColumn("_h", hash60(F.lit(str(seed)), F.col(conv))).orderBy("_h", conv).limit(n).drop("_h")


def packages(sampled: DataFrame, turns: DataFrame, metadata: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One package per sampled conversation with its turns in order, metadata left-joined (the first row per
    conversation wins), packages with fewer than two turns dropped.  A package is one conversation by definition."""
    nested = turns.groupBy(conv).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "label"))).alias("turns"))
    rest = [c for c in metadata.columns if c not in (conv, "ord")]
    first = metadata.groupBy(conv).agg(F.min_by(F.struct(*rest), "ord").alias("meta"))
    return sampled.join(nested, conv).join(first, conv, "left").filter(F.size("turns") >= 2)


def split_blind(rows: DataFrame, key: Sequence[str], public: Sequence[str], private: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The public projection and the blind key, sharing only the key columns."""
    return rows.select(*key, *public), rows.select(*key, *private)


def sampling_summary(cands: DataFrame, sample: DataFrame, entropy: str, facets: Sequence[str], width: float = 0.001) -> DataFrame:
    """Long summary (metric, value, number): counts per stratum and facet, entropy extremes, mean and median,
    duplicate conversations."""
    def counts(df: DataFrame, name: str, col: str) -> DataFrame:
        return df.groupBy(F.lit(name).alias("metric"), F.col(col).cast("string").alias("value")).agg(F.count(F.lit(1)).cast("double").alias("number"))

    parts = [counts(cands, "candidates", "stratum"), counts(sample, "sampled", "stratum")]
    parts += [counts(sample, f, f) for f in facets]
    e = sample.groupBy("stratum").agg(F.min(entropy).alias("entropy_min"), F.avg(entropy).alias("entropy_mean"), F.max(entropy).alias("entropy_max"))
    parts.append(e.unpivot(["stratum"], ["entropy_min", "entropy_mean", "entropy_max"], "metric", "number").select(
        "metric", F.col("stratum").alias("value"), "number"))
    med = ranking.median_of(sample.select("stratum", entropy), ["stratum"], entropy, width)
    parts.append(med.select(F.lit("entropy_median").alias("metric"), F.col("stratum").alias("value"), F.col("median").alias("number")))
    dup = sample.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    parts.append(dup.agg(F.count(F.lit(1)).cast("double").alias("number")).select(
        F.lit("duplicate_conversations").alias("metric"), F.lit("all").alias("value"), "number"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def blind_options(rows: DataFrame, example: str, method: str, seed: object = 0) -> DataFrame:
    """Methods of each example in seeded order, lettered from A.  A group is the methods of one example."""
    h = hash60(F.lit(str(seed)), F.col(example), F.col(method))
    w = Window.partitionBy(example).orderBy(h, method)
    return rows.withColumn("option", F.char(F.lit(64) + F.row_number().over(w)))
