"""Votes to soft labels, uncertainty and agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranking
from ..functions.keys import small_side
from ..functions.lineage import checkpointed

# Agreement buckets from closest to widest.
BUCKETS = ["4_of_4", "3_of_4", "2_of_4", "all_different"]


def label_mass(votes: DataFrame, keys: Sequence[str], label: str = "label", conf: str = "confidence") -> DataFrame:
    """Votes of one item and label merged.  Partial aggregation absorbs an item with very many votes."""
    return votes.groupBy(*keys, label).agg(
        F.sum(conf).cast("double").alias("mass"), F.count(F.lit(1)).alias("support"), F.avg(conf).alias("row_conf")
    )


def share_of_item(mass: DataFrame, keys: Sequence[str], value: str = "mass", out: str = "p") -> DataFrame:
    """Divide by the item total.  The window holds one row per distinct label, so it is vocabulary-bounded."""
    total = F.sum(value).over(Window.partitionBy(*keys))
    return mass.withColumn(out, F.col(value) / total)


def soft_labels(votes: DataFrame, keys: Sequence[str], label: str = "label", conf: str = "confidence") -> DataFrame:
    """L1: confidence-weighted label distribution; votes without positive confidence are skipped."""
    kept = votes.filter((F.col(conf) > 0) & F.col(label).isNotNull())
    return share_of_item(label_mass(kept, keys, label, conf), keys)


def label_order(keys: Sequence[str], label: str = "label") -> Window:
    """Order of labels inside an item: probability descending, then label."""
    return Window.partitionBy(*keys).orderBy(F.desc("p"), F.asc(label))


def vote_rejects(votes: DataFrame, inventory: DataFrame, label: str = "label", conf: str = "confidence") -> DataFrame:
    """L2 errors: label outside the inventory, or confidence outside 1..5."""
    known = small_side(inventory.select(F.col(label)).distinct().withColumn("_known", F.lit(True)))
    checked = votes.join(known, label, "left")
    rule = F.when(F.col("_known").isNull(), F.lit("unknown_label")).when(
        F.col(conf).isNull() | ~F.col(conf).between(1, 5), F.lit("confidence_out_of_range")
    )
    return checked.withColumn("rule", rule).filter("rule is not null").drop("_known")


def strict_distribution(
    votes: DataFrame, inventory: DataFrame, keys: Sequence[str], label: str = "label", conf: str = "confidence",
    weighted: bool = True,
) -> DataFrame:
    """L2: label distribution over accepted votes only, weighted by confidence or 1/n per vote.

    `vote_rejects` lists what is left out; callers that need the strict form check it is empty.
    """
    known = small_side(inventory.select(label).distinct())
    good = votes.join(known, label, "left_semi").filter(F.col(conf).between(1, 5))
    mass = label_mass(good, keys, label, conf)
    return share_of_item(mass, keys, "mass" if weighted else "support")


def merged_votes(
    votes: DataFrame, keys: Sequence[str], vocabulary: DataFrame, label: str = "label", conf: str = "confidence"
) -> DataFrame:
    """L3: clip confidence at 0, ignore blank labels and labels outside the vocabulary; items left without
    mass become uniform over the vocabulary."""
    vocab = small_side(vocabulary.select(label).distinct())
    usable = F.col(label).isNotNull() & (F.trim(F.col(label).cast("string")) != "")
    clipped = votes.withColumn("_c", F.when(usable, F.greatest(F.col(conf).cast("double"), F.lit(0.0))))
    known = vocab.withColumn("_in", F.lit(True))
    mass = (
        clipped.join(small_side(known), label, "left")
        .withColumn("_c", F.when(F.col("_in"), F.col("_c")))
        .groupBy(*keys, label)
        .agg(F.sum("_c").alias("mass"))
        .withColumn("_total", F.sum("mass").over(Window.partitionBy(*keys)))
    )
    kept = mass.filter((F.col("_total") > 0) & (F.col("mass") > 0)).select(
        *keys, label, (F.col("mass") / F.col("_total")).alias("p")
    )
    empty = mass.filter(F.coalesce(F.col("_total"), F.lit(0.0)) <= 0).select(*keys).distinct()
    n = vocab.agg(F.count(F.lit(1)).alias("_v"))
    # Label rows per empty item: bounded by the checked vocabulary.
    uniform = empty.crossJoin(small_side(vocab.crossJoin(F.broadcast(n)))).select(
        *keys, label, (F.lit(1.0) / F.col("_v")).alias("p")
    )
    return kept.unionByName(uniform)


def entropy_of(p: str = "p", bits: bool = True) -> Column:
    log = F.log2 if bits else F.ln
    return -F.sum(F.when(F.col(p) > 0, F.col(p) * log(F.col(p))).otherwise(F.lit(0.0)))


def item_uncertainty(soft: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """L4: entropy in bits, effective label count, nonzero count, top label with its probability, mean confidence.

    Expects the columns of `soft_labels`; the top label is the smallest label among the most probable.
    """
    agg = soft.groupBy(*keys).agg(
        entropy_of("p").alias("entropy_bits"),
        F.sum(F.when(F.col("p") > 0, 1).otherwise(0)).cast("long").alias("nonzero"),
        F.min(F.struct((-F.col("p")).alias("n"), F.col(label).alias("l"))).alias("_top"),
        (F.sum("mass") / F.sum("support")).alias("mean_conf"),
    )
    return agg.select(
        *keys,
        "entropy_bits",
        F.pow(F.lit(2.0), F.col("entropy_bits")).alias("effective_labels"),
        "nonzero",
        F.col("_top.l").alias("top_label"),
        (-F.col("_top.n")).alias("top_p"),
        "mean_conf",
    )


def canonical_table(soft: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """One row per (item, label) with the item columns repeated, in one pass over one window key."""
    item = Window.partitionBy(*keys)
    top = F.min(F.struct((-F.col("p")).alias("n"), F.col(label).alias("l"))).over(item)
    h = -F.sum(F.when(F.col("p") > 0, F.col("p") * F.log2("p")).otherwise(0.0)).over(item)
    return soft.select(
        *keys,
        label,
        "p",
        "support",
        "row_conf",
        h.alias("entropy_bits"),
        F.count(F.lit(1)).over(item).alias("nonzero"),
        top["l"].alias("top_label"),
        (-top["n"]).alias("top_p"),
        (F.sum("mass").over(item) / F.sum("support").over(item)).alias("mean_conf"),
        F.row_number().over(label_order(keys, label)).cast("long").alias("label_rank"),
    )


def observed_counts(soft: DataFrame, label: str = "label", support: str = "support") -> DataFrame:
    """Total support per label; a missing support counts as one."""
    return soft.groupBy(label).agg(F.sum(F.coalesce(F.col(support), F.lit(1))).cast("long").alias("observed"))


def bucket_of(majority: Column, strict: bool = False, total: Column | None = None) -> Column:
    """Agreement bucket from the largest vote count; the strict form wants exactly four votes."""
    base = (
        F.when(majority >= 4, F.lit("4_of_4")).when(majority == 3, F.lit("3_of_4"))
        .when(majority == 2, F.lit("2_of_4")).otherwise(F.lit("all_different"))
    )
    return F.when(total != 4, F.lit("other")).otherwise(base) if strict else base


def agreement(
    votes: DataFrame, keys: Sequence[str], label: str = "label", strict: bool = False
) -> DataFrame:
    """Sorted vote-count pattern such as `3-1`, bucket, majority count, majority labels, unique labels."""
    counts = votes.filter(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    # The lists below hold distinct labels of one item, so at most the vocabulary.
    per_item = counts.groupBy(*keys).agg(
        F.sort_array(F.collect_list("n"), asc=False).alias("_counts"),
        F.sort_array(F.collect_list(F.struct("n", F.col(label).alias("l")))).alias("_pairs"),
        F.max("n").alias("majority_count"),
        F.sum("n").alias("vote_count"),
        F.count(F.lit(1)).alias("unique_labels"),
    )
    majority = F.transform(
        F.filter("_pairs", lambda x: x["n"] == F.col("majority_count")), lambda x: x["l"].cast("string")
    )
    return per_item.select(
        *keys,
        F.array_join(F.transform("_counts", lambda x: x.cast("string")), "-").alias("pattern"),
        bucket_of(F.col("majority_count"), strict, F.col("vote_count")).alias("bucket"),
        "majority_count",
        F.array_join(majority, ",").alias("majority_labels"),
        "unique_labels",
        "vote_count",
    )


def rounded_soft_labels(votes: DataFrame, keys: Sequence[str], label: str = "label", conf: str = "confidence") -> DataFrame:
    """Probabilities rounded to 8 decimals, entropy computed on the rounded values."""
    soft = soft_labels(votes, keys, label, conf).withColumn("p", F.round("p", 8))
    return soft.groupBy(*keys).agg(
        F.round(entropy_of("p"), 8).alias("entropy_rounded"), F.max("p").alias("top_p_rounded"),
    )


def agreement_rollup(items: DataFrame, groups: Sequence[str] = ("split", "role")) -> DataFrame:
    """Counts, rates and means for all combinations of the grouping columns (cube), with exact medians.

    Absent groups of the dense grid come back with zero counts.  Expects bucket, pattern, entropy,
    majority_fraction, top_p and unique_labels per item.
    """
    groups = list(groups)
    parts = {b: F.sum(F.when(F.col("bucket") == b, 1).otherwise(0)).cast("long") for b in BUCKETS}
    stats = items.cube(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        *[c.alias("n_" + b) for b, c in parts.items()],
        F.avg("entropy").alias("mean_entropy"),
        F.avg("majority_fraction").alias("mean_majority"),
        F.avg("top_p").alias("mean_top_p"),
        F.avg("unique_labels").alias("mean_unique"),
        *[F.grouping(g).cast("int").alias(f"_total_{g}") for g in groups],
    )
    stats = stats.withColumns({g: F.when(F.col(f"_total_{g}") == 1, F.lit("all")).otherwise(F.col(g).cast("string")) for g in groups})
    # Medians on the same cube: merge equal entropies first, expand the cube on the merged rows.
    total = [f"_total_{g}" for g in groups]
    slim = items.select(*groups, "entropy")
    cubed = slim.select("entropy", F.explode(_cube_keys(groups)).alias("_g")).select("entropy", "_g.*")
    keyed = [*groups, *total]
    med = ranking.median_of(cubed.withColumns({f"_null_{g}": F.col(g).isNull() for g in groups}).fillna("", groups),
                            [*keyed, *[f"_null_{g}" for g in groups]], "entropy", 0.01, "median_entropy")
    med = med.select(*[F.when(~F.col(f"_null_{g}"), F.col(g)).alias(g) for g in groups], *total, "median_entropy")
    # The aggregate is a few rows per group; the dense grid is drawn from it instead of from the items.
    named = checkpointed(stats)
    grid = None
    for g, t in zip(groups, total):
        side = named.select(g, t).distinct()
        grid = side if grid is None else grid.crossJoin(F.broadcast(side))  # group names only

    def attach(left: DataFrame, right: DataFrame) -> DataFrame:
        """Null groups are groups of their own, and the total of a group is never one of its values."""
        renamed = right.select(*[F.col(c).alias(f"_r{c}" if c in keyed else c) for c in right.columns])
        on = [F.col(c).eqNullSafe(F.col(f"_r{c}")) for c in keyed]
        return left.join(renamed, on, "left").drop(*[f"_r{c}" for c in keyed])

    full = attach(attach(grid, named), med)
    rates = [F.when(F.col("n") > 0, F.col("n_" + b) / F.col("n")).otherwise(0.0).alias("rate_" + b) for b in BUCKETS]
    filled = full.fillna(0, ["n", *["n_" + b for b in BUCKETS]])
    return filled.select(*filled.columns, *rates).drop(*total)


def _cube_keys(groups: Sequence[str]) -> Column:
    combos: list[Column] = []
    for mask in range(2 ** len(groups)):
        cells = []
        for i, g in enumerate(groups):
            kept = bool(mask >> i & 1)
            cells += [(F.col(g).cast("string") if kept else F.lit("all")).alias(g), F.lit(0 if kept else 1).alias(f"_total_{g}")]
        combos.append(F.struct(*cells))
    return F.array(*combos)


def pattern_rates(items: DataFrame, groups: Sequence[str] = ("split",)) -> DataFrame:
    """Count and rate per vote-count pattern inside each group."""
    counts = items.groupBy(*groups, "pattern").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy(*groups)))


def complete_items(
    votes: DataFrame, keys: Sequence[str], annotators: int, label: str = "label", conf: str = "confidence"
) -> DataFrame:
    """Flag items on which every annotator gave both a label and a confidence."""
    usable = F.col(label).isNotNull() & F.col(conf).isNotNull()
    return votes.groupBy(*keys).agg(
        (F.countDistinct(F.when(usable, F.col("annotator"))) >= annotators).alias("complete")
    )


def pool_check(pool: DataFrame, observed: DataFrame, clustered: DataFrame, label: str = "label") -> DataFrame:
    """One row per label of the pool or the regions: in pool, observed, zero frequency, clustered and
    zero, clustered but outside the pool."""
    p = pool.select(label).distinct().withColumn("_p", F.lit(True))
    o = observed.filter("observed > 0").select(label).distinct().withColumn("_o", F.lit(True))
    c = clustered.select(label).distinct().withColumn("_c", F.lit(True))
    joined = p.join(o, label, "full").join(c, label, "full").fillna(False, ["_p", "_o", "_c"])
    return joined.select(
        label,
        F.col("_p").alias("in_pool"),
        F.col("_o").alias("is_observed"),
        (F.col("_p") & ~F.col("_o")).alias("zero_frequency"),
        (F.col("_c") & F.col("_p") & ~F.col("_o")).alias("clustered_zero"),
        (F.col("_c") & ~F.col("_p")).alias("clustered_outside_pool"),
    )


def annotator_labels(votes: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """Annotator labels in annotator order next to the agreement bucket.

    One list entry per (item, annotator): a repeated vote of an annotator keeps the largest label.
    """
    one = votes.groupBy(*keys, "annotator").agg(F.max(label).alias(label))
    listed = one.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("annotator", label))), lambda x: x[label]).alias("labels")
    )
    return listed.join(agreement(one, keys, label).select(*keys, "bucket"), list(keys))
