"""Soft membership of labels in regions and projection of items onto regions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dist as D
from ..functions.keys import agreement_rank, finite_double, small_side
from .softlabel import BUCKETS, bucket_of

# Tolerance of mass checks, guard in divisions, sharpening temperature, boundary thresholds.
TOLERANCE = 1e-12
VECTOR_EPS = 1e-12
TEMPERATURE = 0.7
# Mass that an item may have outside the membership.
MASS_TOLERANCE = 1e-6
BOUNDARY_FLOOR = 0.70
BOUNDARY_SHARE = 0.85
BOUNDARY_KEEP = 4


def missing_mass(soft: DataFrame, membership: DataFrame, label: str = "label") -> DataFrame:
    """P1 report: labels without membership and the probability mass they carry."""
    known = small_side(membership.select(label).distinct())
    return soft.join(known, label, "left_anti").groupBy(label).agg(F.sum("p").alias("missing_mass"))


def project(
    soft: DataFrame, membership: DataFrame, keys: Sequence[str], label: str = "label", renormalize: bool = False
) -> DataFrame:
    """r(region | item) = sum over labels of q * m.  Regions with mass at or below 1e-12 are dropped.

    The membership side is broadcast when small; the sum combines before the shuffle.  Labels without
    membership contribute nothing: check `missing_mass` where they must not occur, or renormalise.
    """
    joined = soft.select(*keys, label, "p").join(small_side(membership.select(label, "region", "m")), label)
    out = joined.groupBy(*keys, "region").agg(F.sum(F.col("p") * F.col("m")).alias("p"))
    if renormalize:
        out = out.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy(*keys)))
    return out.filter(F.col("p") > TOLERANCE)


def project_complete(soft: DataFrame, membership: DataFrame, keys: Sequence[str], label: str = "label", tolerance: float = MASS_TOLERANCE) -> DataFrame:
    """P1 over items whose labels all have a membership: (keys, region, p), p scaled to sum 1.

    An item with more than `tolerance` of its mass outside the membership has no rows here; `projection_rejects` reports it.  One
    aggregate per item decides both, so nothing is joined back.
    """
    known = membership.select(label, "region", "m")
    joined = soft.select(*keys, label, "p").join(known, label, "left")
    by_region = joined.groupBy(*keys, "region").agg(F.sum(F.col("p") * F.coalesce("m", F.lit(0.0))).alias("r"), F.sum(F.when(F.col("m").isNull(), F.col("p")).otherwise(0.0)).alias("out"))
    item = Window.partitionBy(*keys)  # the regions of one item
    placed = by_region.withColumns({"_out": F.sum("out").over(item), "_all": F.sum("r").over(item)})
    kept = placed.filter((F.col("_out") <= tolerance) & (F.col("_all") > 0) & F.col("region").isNotNull())
    return kept.select(*keys, "region", (F.col("r") / F.col("_all")).alias("p")).filter(F.col("p") > TOLERANCE)


def projection_rejects(soft: DataFrame, membership: DataFrame, keys: Sequence[str], label: str = "label", tolerance: float = MASS_TOLERANCE) -> DataFrame:
    """P1 report: (keys, missing_labels, missing_mass) of the items that `project_complete` leaves out."""
    known = membership.select(label).distinct().withColumn("_known", F.lit(True))
    lost = soft.select(*keys, label, "p").join(known, label, "left").filter("_known IS NULL AND p > 0")
    return lost.groupBy(*keys).agg(F.count(F.lit(1)).alias("missing_labels"), F.sum("p").alias("missing_mass")).filter(F.col("missing_mass") > tolerance)


def dense_regions(regional: DataFrame, keys: Sequence[str], size: int, out: str = "dist") -> DataFrame:
    """Region rows of an item folded into one dense array, one sum per region (no list of rows is built)."""
    sums = [F.sum(F.when(F.col("region") == r, F.col("p")).otherwise(0.0)) for r in range(size)]
    return regional.groupBy(*keys).agg(F.array(*sums).alias(out))


def item_vectors(soft: DataFrame, label_vectors: DataFrame, keys: Sequence[str], dim: int, label: str = "label") -> DataFrame:
    """z = sum over labels of q * v, as one partial-aggregated sum per component."""
    joined = soft.select(*keys, label, "p").join(small_side(label_vectors), label)
    parts = [F.sum(F.col("p") * F.element_at("v", i + 1)) for i in range(dim)]
    return joined.groupBy(*keys).agg(F.array(*parts).alias("z"))


def reliability(entropy: Column, regions: int, mean_conf: Column) -> Column:
    """clamp(conf / 5 * clamp(1 - H / ln C)); without confidence only the uncertainty factor."""
    factor = F.lit(1.0) if regions <= 1 else 1 - entropy / F.ln(F.lit(float(regions)))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), factor))
    weighted = F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean_conf / 5.0 * clamped))
    return F.when(mean_conf.isNull(), clamped).otherwise(weighted)


def region_uncertainty(regional: DataFrame, keys: Sequence[str], regions: int, item_conf: DataFrame) -> DataFrame:
    """Entropy in nats, normalised entropy, top region (ties: smallest id), nonzero count, reliability."""
    agg = regional.groupBy(*keys).agg(
        (-F.sum(F.when(F.col("p") > 0, F.col("p") * F.ln("p")).otherwise(0.0))).alias("entropy"),
        F.min(F.struct((-F.col("p")).alias("n"), F.col("region").alias("r"))).alias("_top"),
        F.count(F.lit(1)).alias("nonzero"),
    )
    log_c = F.ln(F.lit(float(regions)))
    return agg.join(item_conf, list(keys), "left").select(
        *keys,
        "entropy",
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("entropy") / log_c)).alias("norm_entropy"),
        F.col("_top.r").alias("top_region"),
        (-F.col("_top.n")).alias("top_p"),
        "nonzero",
        reliability(F.col("entropy"), regions, F.col("mean_conf")).alias("reliability"),
    )


def conditioned_vectors(
    soft: DataFrame, membership: DataFrame, local: DataFrame, keys: Sequence[str], dim: int, top_k: int = 3,
    label: str = "label",
) -> DataFrame:
    """Per (item, region) the vector sum(q * m * v(label, region)) / (r + eps), its norm, the entropy of
    the contributions (nats) and the top contributing labels with their weights.

    `local` holds (label, region, v).  Pairs without a local vector drop the (item, region) row; use
    `quality.missing_keys` to list them first where they must not occur.
    """
    parts = soft.select(*keys, label, "p").join(small_side(membership.select(label, "region", "m")), label)
    parts = parts.withColumn("w", F.col("p") * F.col("m")).filter("w > 0")
    parts = parts.join(small_side(local), [label, "region"], "left")
    sums = [F.sum(F.col("w") * F.element_at("v", i + 1)) for i in range(dim)]
    # The list holds one entry per distinct label of the item: bounded by the vocabulary.
    agg = parts.groupBy(*keys, "region").agg(
        F.sum("w").alias("r"),
        F.array(*sums).alias("num"),
        F.count(F.lit(1)).alias("contributors"),
        F.sum(F.when(F.col("v").isNull(), F.col("w")).otherwise(0.0)).alias("_missing"),
        F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("n"), F.col(label).alias("l")))).alias("_c"),
    ).filter((F.col("_missing") <= 0) & (F.col("r") > TOLERANCE))
    scale = F.col("r") + VECTOR_EPS
    weights = F.transform("_c", lambda x: -x["n"] / scale)
    return agg.select(
        *keys,
        "region",
        "r",
        F.transform("num", lambda x: x / scale).alias("vector"),
        "contributors",
        D.entropy(weights).alias("contribution_entropy"),
        F.slice(F.transform("_c", lambda x: x["l"]), 1, top_k).alias("top_labels"),
        F.slice(weights, 1, top_k).alias("top_weights"),
    ).withColumn("vector_norm", D.norm2(F.col("vector")))


def projection_summary(items: DataFrame) -> DataFrame:
    """P5: overall averages, entropy and top-1 means per role, and whether B is more concentrated than A.

    Expects role, entropy, top_p, nonzero per item.
    """
    def role(name: str, value: str) -> Column:
        return F.avg(F.when(F.upper(F.trim("role")) == name, F.col(value)))

    agg = items.agg(
        F.count(F.lit(1)).alias("items"),
        F.sum("nonzero").cast("long").alias("item_region_pairs"),
        F.avg("nonzero").alias("avg_nonzero"),
        F.avg("entropy").alias("avg_entropy"),
        F.avg("top_p").alias("avg_top_p"),
        role("A", "entropy").alias("a_entropy"),
        role("B", "entropy").alias("b_entropy"),
        role("A", "top_p").alias("a_top_p"),
        role("B", "top_p").alias("b_top_p"),
    )
    flag = (F.col("b_entropy") < F.col("a_entropy")) & (F.coalesce("b_top_p", F.lit(0.0)) > F.coalesce("a_top_p", F.lit(0.0)))
    return agg.withColumn("b_more_concentrated", flag)


def from_supports(candidates: DataFrame, primaries: DataFrame, label: str = "label", temperature: float = TEMPERATURE) -> DataFrame:
    """Raw and sharpened membership from supports of candidate regions.

    `candidates` has (label, region, support), `primaries` has (label, primary).  The largest positive finite
    support of a region counts; a primary region that is not a candidate enters with the largest support;
    a label without candidates becomes one-hot on its primary.
    """
    usable = candidates.withColumn("support", finite_double(F.col("support"))).filter("support > 0")
    best = usable.groupBy(label, "region").agg(F.max("support").alias("support"))
    peak = best.groupBy(label).agg(F.max("support").alias("_peak"))
    injected = primaries.join(peak, label, "left").select(
        label, F.col("primary").alias("region"), F.col("_peak").alias("support")
    )
    absent = injected.join(best, [label, "region"], "left_anti")
    rows = best.join(primaries.select(label), label, "left_semi").unionByName(absent)
    item = Window.partitionBy(label)
    weight = F.coalesce("support", F.lit(1.0))
    raw = rows.withColumn("raw", weight / F.sum(weight).over(item))
    powered = F.pow(F.col("raw"), F.lit(1.0 / temperature))
    return raw.select(
        label,
        "region",
        "raw",
        (powered / F.sum(powered).over(item)).alias("sharp"),
        F.when(F.count(F.lit(1)).over(item) > 1, "soft_candidate").otherwise("onehot").alias("source_type"),
        "support",
    )


def ambiguous_labels(rows: DataFrame, k: int, p: str = "raw", label: str = "label", observed: str = "observed") -> DataFrame:
    """The k labels with the widest membership: entropy (bits), region count, observed count, rendering."""
    entry = F.struct((-F.col(p)).alias("n"), F.col("region").cast("string").alias("r"))
    agg = rows.groupBy(label).agg(
        (-F.sum(F.when(F.col(p) > 0, F.col(p) * F.log2(p)).otherwise(0.0))).alias("entropy_bits"),
        F.count(F.lit(1)).alias("regions"),
        F.max(observed).alias("observed"),
        F.sort_array(F.collect_list(entry)).alias("_m"),
    )
    text = F.array_join(F.transform("_m", lambda x: F.format_string("%s:%.4f", x["r"], -x["n"])), ", ")
    return (
        agg.select(label, "entropy_bits", "regions", "observed", text.alias("memberships"))
        .orderBy(F.desc(F.round("entropy_bits", 9)), F.desc("regions"), F.desc(F.coalesce("observed", F.lit(0))), label)
        .limit(k)
    )


def membership_summary(rows: DataFrame, label: str = "label") -> DataFrame:
    """Label counts by kind, regions per label, largest deviation of the raw and sharp sums from 1."""
    per = rows.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("raw").alias("raw"),
        F.sum("sharp").alias("sharp"),
        F.max(F.when(F.col("source_type") == "onehot", 1).otherwise(0)).alias("one"),
    )
    is_one = (F.col("n") == 1) & (F.col("one") == 1)
    return per.agg(
        F.count(F.lit(1)).alias("labels"),
        F.sum(is_one.cast("long")).alias("onehot_labels"),
        F.sum((~is_one).cast("long")).alias("soft_labels"),
        F.avg("n").alias("regions_per_label"),
        F.max(F.abs(F.col("raw") - 1)).alias("max_raw_error"),
        F.max(F.abs(F.col("sharp") - 1)).alias("max_sharp_error"),
    )


def boundary_candidates(affinity: DataFrame, assignment: DataFrame) -> DataFrame:
    """Labels that also lean to other regions.

    `affinity` is (src, dst, w) over ordered label pairs, `assignment` is (label, region).  The support of a
    region is the largest affinity to one of its other members.  Other regions are kept from
    max(0.70, 0.85 * own) upwards; own first, then by support, at most four per label (that is the operator).
    """
    a = small_side(assignment)
    links = affinity.filter("src <> dst").join(
        a.select(F.col("label").alias("dst"), F.col("region").alias("region")), "dst"
    )
    support = links.groupBy("src", "region").agg(F.max("w").alias("support"))
    own = a.select(F.col("label").alias("src"), F.col("region").alias("own"))
    joined = support.join(own, "src")
    own_support = F.max(F.when(F.col("region") == F.col("own"), F.col("support"))).over(Window.partitionBy("src"))
    scored = joined.withColumn("_own", F.coalesce(own_support, F.lit(0.0)))
    cross = scored.filter(
        (F.col("region") != F.col("own"))
        & (F.col("support") >= F.greatest(F.lit(BOUNDARY_FLOOR), F.col("_own") * BOUNDARY_SHARE))
    ).select("src", "region", "support", F.lit(1).alias("_k"))
    first = cross.select("src").distinct().join(
        scored.groupBy("src").agg(F.first("own").alias("region"), F.first("_own").alias("support")), "src"
    ).select("src", "region", "support", F.lit(0).alias("_k"))
    w = Window.partitionBy("src").orderBy("_k", F.desc("support"), "region")
    ranked = first.unionByName(cross).withColumn("rank", F.row_number().over(w).cast("long"))
    return ranked.filter(F.col("rank") <= BOUNDARY_KEEP).select(F.col("src").alias("label"), "region", "support", "rank")


def top_region(membership: DataFrame, label: str = "label") -> DataFrame:
    return membership.groupBy(label).agg(
        F.min(F.struct((-F.col("m")).alias("n"), F.col("region").alias("r")))["r"].alias("region")
    )


def representations(
    soft: DataFrame, versions: dict[str, DataFrame], votes: DataFrame, keys: Sequence[str], label: str = "label"
) -> DataFrame:
    """P10: entropy (bits), top-1, nonzero count and agreement bucket of the label distribution and of each
    region projection, with the deltas to the label form.  `versions` maps a name to (label, region, m)."""

    def stats(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(
            F.lit(name).alias("representation"),
            (-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log2("p")).otherwise(0.0))).alias("entropy_bits"),
            F.max("p").alias("top_p"),
            F.sum(F.when(F.col("p") > 0, 1).otherwise(0)).cast("long").alias("nonzero"),
        )

    def bucket(df: DataFrame, col: str) -> DataFrame:
        counts = df.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("n"))
        return counts.groupBy(*keys).agg(bucket_of(F.max("n")).alias("bucket"))

    base = stats(soft, "label").join(bucket(votes, label), list(keys), "left")
    frames = [base.withColumn("label_bucket", F.col("bucket")).withColumn("d_entropy", F.lit(0.0)).withColumn("d_top", F.lit(0.0))]
    ref = base.select(
        *keys, F.col("entropy_bits").alias("_h"), F.col("top_p").alias("_t"), F.col("bucket").alias("label_bucket")
    )
    for name, m in versions.items():
        mapped = votes.select(*keys, label).join(small_side(top_region(m, label)), label)
        region_form = stats(project(soft, m, keys, label), name).join(bucket(mapped, "region"), list(keys), "left")
        frames.append(
            region_form.join(ref, list(keys))
            .withColumn("d_entropy", F.col("entropy_bits") - F.col("_h"))
            .withColumn("d_top", F.col("top_p") - F.col("_t"))
            .drop("_h", "_t")
        )
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def stability_aggregate(rows: DataFrame, group: str | None = None) -> DataFrame:
    """Per (group, representation) means, bucket counts and rates, and the shares of items whose
    agreement improved, degraded or stayed against the label form."""
    value = F.lit("all") if group is None else F.col(group).cast("string")
    up = F.when(F.col("representation") != "label", agreement_rank(F.col("bucket")) - agreement_rank(F.col("label_bucket")))
    counts = [F.sum((F.col("bucket") == b).cast("long")).alias("n_" + b) for b in BUCKETS]
    agg = rows.withColumn("_up", up).groupBy(value.alias("group_value"), "representation").agg(
        F.count(F.lit(1)).alias("items"),
        F.count("bucket").alias("with_agreement"),
        F.avg("entropy_bits").alias("mean_entropy"),
        F.avg("top_p").alias("mean_top_p"),
        F.avg("nonzero").alias("mean_nonzero"),
        F.avg("d_entropy").alias("mean_d_entropy"),
        F.avg("d_top").alias("mean_d_top"),
        F.avg((F.col("_up") > 0).cast("double")).alias("improved_rate"),
        F.avg((F.col("_up") < 0).cast("double")).alias("degraded_rate"),
        F.avg((F.col("_up") == 0).cast("double")).alias("unchanged_rate"),
        *counts,
    )
    rates = [
        F.when(F.col("with_agreement") > 0, F.col("n_" + b) / F.col("with_agreement")).otherwise(0.0).alias("rate_" + b)
        for b in BUCKETS
    ]
    return agg.select("*", *rates)


# Thresholds of the recommendation between the raw and the sharpened membership.
ENTROPY_GAIN, TOP_GAIN, DEGRADED_SLACK, TINY_GAIN = 0.02, 0.005, 0.005, 0.002


def recommend(overall: DataFrame) -> DataFrame:
    """One row with the two recommendations drawn from the overall aggregate (`label`, `raw`, `sharp`)."""
    def pick(rep: str, col: str) -> Column:
        return F.max(F.when(F.col("representation") == rep, F.col(col)))

    one = overall.agg(
        *[pick(rep, col).alias(f"{rep}_{col}") for rep in ("label", "raw", "sharp")
          for col in ("mean_entropy", "mean_top_p", "degraded_rate")]
    )
    c = F.col
    degraded_ok = F.coalesce("sharp_degraded_rate", F.lit(0.0)) <= F.coalesce("raw_degraded_rate", F.lit(0.0)) + DEGRADED_SLACK
    sharpen = (
        (c("raw_mean_entropy") - c("sharp_mean_entropy") > ENTROPY_GAIN)
        & (c("sharp_mean_top_p") - c("raw_mean_top_p") > TOP_GAIN)
        & degraded_ok
    )
    drop, gain = c("label_mean_entropy") - c("raw_mean_entropy"), c("raw_mean_top_p") - c("label_mean_top_p")
    conservative = c("raw_mean_entropy") <= c("sharp_mean_entropy") + 1e-9
    tiny = F.abs(c("sharp_mean_top_p") - c("raw_mean_top_p")) < TINY_GAIN
    return one.select(
        F.when(sharpen, "sharpened").otherwise("raw").alias("recommended"),
        ((drop > 0) & (gain > 0) & (conservative | tiny)).alias("use_raw"),
    )


def local_vectors(
    membership: DataFrame, vectors: DataFrame, similarity: DataFrame | None, dim: int, k: int = 5, tau: float = 0.15,
    min_size: int = 3, label: str = "label",
) -> DataFrame:
    """Vector of a label inside a region, smoothed over its k most similar members (itself first).

    The member join runs inside one region over labels, so it holds at most labels x labels rows and never
    depends on the number of items.  `similarity` is (src, dst, w); pairs it lacks fall back to the cosine.
    """
    members = membership.select("region", label, "m").join(small_side(vectors), label)
    size = F.count(F.lit(1)).over(Window.partitionBy("region"))
    left = members.withColumn("size", size)
    right = members.select("region", F.col(label).alias("nb"), F.col("v").alias("nv"))
    limit = F.when(F.col("size") < min_size, F.lit(1)).otherwise(F.lit(k))
    joined = left.join(right, "region")
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), D.cosine(F.col("v"), F.col("nv"))))
    if similarity is not None:
        known = small_side(similarity.select(F.col("src").alias(label), F.col("dst").alias("nb"), F.col("w").alias("_w")))
        joined = joined.join(known, [label, "nb"], "left").withColumn("sim", F.coalesce("_w", cos)).drop("_w")
    else:
        joined = joined.withColumn("sim", cos)
    pair = Window.partitionBy("region", label)
    order = pair.orderBy((F.col("nb") != F.col(label)).cast("int"), F.desc(F.round("sim", 9)), "nb")
    near = joined.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    e = F.exp((F.col("sim") - F.max("sim").over(pair)) / tau)
    near = near.withColumn("_e", e).withColumn("weight", F.col("_e") / F.sum("_e").over(pair))
    sums = [F.sum(F.col("weight") * F.element_at("nv", i + 1)) for i in range(dim)]
    out = near.groupBy("region", label).agg(
        F.first("m").alias("m"),
        F.first("size").alias("region_size"),
        F.first("v").alias("global_vector"),
        F.array(*sums).alias("local_vector"),
        F.count(F.lit(1)).alias("neighbours"),
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "nb"))), lambda x: x["nb"]).alias("neighbour_labels"),
    )
    g, l = F.col("global_vector"), F.col("local_vector")
    return out.select(
        "*",
        (F.col("region_size") < min_size).alias("fallback"),
        D.norm2(F.zip_with(l, g, lambda x, y: x - y)).alias("l2_delta"),
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), D.cosine(g, l))).alias("cosine"),
    )


def frequent_ambiguous(local: DataFrame, n: int = 12, label: str = "label") -> DataFrame:
    """Most frequent labels with soft membership (observed desc, membership desc, label, region)."""
    soft = local.filter("source_type = 'soft_candidate'")
    return soft.orderBy(F.desc(F.coalesce("observed", F.lit(0))), F.desc(F.round("m", 9)), label, "region").limit(n)


def largest_changes(local: DataFrame, n: int = 8, label: str = "label") -> DataFrame:
    """Labels with soft membership that smoothing moved most."""
    soft = local.filter("source_type = 'soft_candidate'")
    return soft.orderBy(F.desc(F.round("l2_delta", 9)), label, "region").limit(n)


def most_mixed(conditioned: DataFrame, keys: Sequence[str], n: int = 8) -> DataFrame:
    """(item, region) vectors with several contributors and the widest contribution entropy."""
    mixed = conditioned.filter((F.col("contributors") > 1) & (F.col("contribution_entropy") > 0))
    return mixed.orderBy(
        F.desc(F.round("contribution_entropy", 9)), F.desc(F.round("r", 9)), *keys, "region"
    ).limit(n)


# Labels that stand for another one, characters that take a text selector, skin tones, gender signs.
ALIASES = {"🌜": "🌛", "😗": "😚", "😙": "😚", "😶\u200d🌫": "😶\u200d🌫️"}
SELECTOR = "\ufe0f"
TEXT_PRESENTATION = "[\u2639\u263a\u2642\u2640\U0001F32B]"
SKIN_TONES = "[\U0001F3FB-\U0001F3FF]"
GENDER = "\u200d?[\u2642\u2640]"


def resolve_labels(labels: DataFrame, membership: DataFrame, label: str = "label") -> DataFrame:
    """Membership row of every label, by the first rule that finds one: exact, then an alias or a form with
    selectors, skin tones or gender signs changed (`unicode_alias`), else uniform over the regions.

    Returns label, region, m, source, alias.  Labels and regions are bounded dimensions.
    """
    x = F.col(label)
    bare, plain = F.replace(x, F.lit(SELECTOR), F.lit("")), F.regexp_replace(F.regexp_replace(x, SKIN_TONES, ""), GENDER, "")
    shown = lambda c: F.regexp_replace(c, f"({TEXT_PRESENTATION})", "$1" + SELECTOR)
    manual = F.lit(None).cast("string")
    for a, b in ALIASES.items():
        manual = F.when(x == a, F.lit(b)).otherwise(manual)
    forms = F.array(x, manual, bare, shown(x), shown(bare), plain, shown(plain))
    known = membership.select(F.col(label).alias("form")).distinct()
    tried = labels.select(label).distinct().select(label, F.posexplode(forms).alias("rule", "form")).filter("form IS NOT NULL AND form <> ''")
    hit = tried.join(small_side(known), "form").groupBy(label).agg(F.min(F.struct("rule", "form")).alias("h"))
    found = labels.select(label).distinct().join(hit, label, "left").select(label, F.col("h.form").alias("form"), F.col("h.rule").alias("rule"))
    rows = found.filter("form IS NOT NULL").join(small_side(membership.select(F.col(label).alias("form"), "region", "m")), "form").select(
        label, "region", "m", F.when(F.col("rule") == 0, "exact").otherwise("unicode_alias").alias("source"), F.when(F.col("rule") > 0, F.col("form")).alias("alias"))
    regions = membership.agg(F.sort_array(F.collect_set("region")).alias("_r"))  # a handful
    uniform = found.filter("form IS NULL").crossJoin(F.broadcast(regions)).select(label, F.explode("_r").alias("region"), "_r").select(
        label, "region", (F.lit(1.0) / F.size("_r")).alias("m"), F.lit("unobserved_uniform").alias("source"), F.lit(None).cast("string").alias("alias"))
    return rows.unionByName(uniform)
