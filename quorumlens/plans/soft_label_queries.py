"""Queries for soft labels and agreement (L) and quality checks (Q1, Q2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import softlabel as sl
from .fixtures import ITEM, LABELS, Tables, r6
from .registry import query


@query("soft_label_L1", uses="soft", sql="SELECT item, label, support, round(p, 6) AS p FROM soft")
def soft_label(t: Tables) -> DataFrame:
    return t.soft.select("item", "label", "support", r6("p"))


@query("soft_label_bulk_L1", sql="""
    SELECT l_orderkey, label, round(mass / sum(mass) OVER (PARTITION BY l_orderkey), 6) AS p FROM (
      SELECT l_orderkey, l_returnflag || l_linestatus AS label, sum(1 + l_quantity::bigint % 5)::double AS mass
      FROM lineitem GROUP BY 1, 2)""")
def soft_label_bulk(t: Tables) -> DataFrame:
    return sl.soft_labels(bulk_votes(t), ["l_orderkey"]).select("l_orderkey", "label", r6("p"))


def bulk_votes(t: Tables) -> DataFrame:
    """Order lines as votes: the order is the item, the line number the annotator."""
    return t.read("lineitem").select(
        "l_orderkey",
        F.col("l_linenumber").alias("annotator"),
        F.concat("l_returnflag", "l_linestatus").alias("label"),
        (1 + F.col("l_quantity").cast("long") % 5).alias("confidence"),
    )


@query("strict_votes_L2", uses="votes", sql="""
    SELECT item, label, round(w / sum(w) OVER (PARTITION BY item), 6) AS p,
      round(n / sum(n) OVER (PARTITION BY item), 6) AS p_unweighted FROM (
      SELECT item, label, sum(confidence)::double AS w, count(*)::double AS n FROM votes
      WHERE label < 20 AND confidence BETWEEN 1 AND 5 GROUP BY item, label)""")
def strict_votes(t: Tables) -> DataFrame:
    inventory = t.membership.filter("label < 20")
    w = sl.strict_distribution(t.votes, inventory, ITEM)
    u = sl.strict_distribution(t.votes, inventory, ITEM, weighted=False)
    return w.select("item", "label", r6("p")).join(u.select("item", "label", r6("p", "p_unweighted")), ["item", "label"])


@query("vote_rejects_L2", uses="votes", sql="""
    SELECT item, annotator, label, CASE WHEN label >= 20 THEN 'unknown_label' ELSE 'confidence_out_of_range' END AS rule
    FROM (SELECT item, annotator, label, confidence + CASE WHEN turn % 5 = 0 THEN 3 ELSE 0 END AS c FROM votes)
    WHERE label >= 20 OR c NOT BETWEEN 1 AND 5""")
def vote_rejects(t: Tables) -> DataFrame:
    shifted = t.votes.withColumn("confidence", F.col("confidence") + F.when(F.col("turn") % 5 == 0, 3).otherwise(0))
    return sl.vote_rejects(shifted, t.membership.filter("label < 20")).select("item", "annotator", "label", "rule")


@query("merged_votes_L3", uses="votes", sql="""
    WITH c AS (SELECT item, label, CASE WHEN label < 9 THEN greatest(confidence - 2, 0)::double END AS c FROM votes),
    tot AS (SELECT item, coalesce(sum(c), 0) AS s FROM c GROUP BY item)
    SELECT item, label, round(sum(c) / any_value(s), 6) AS p FROM c JOIN tot USING (item)
    WHERE s > 0 AND c > 0 GROUP BY item, label
    UNION ALL SELECT item, label, round(1.0::double / 9, 6) FROM tot CROSS JOIN (SELECT unnest(range(0, 9)) AS label) WHERE s <= 0""")
def merged_votes(t: Tables) -> DataFrame:
    votes = t.votes.withColumn("confidence", F.col("confidence") - 2)
    return sl.merged_votes(votes, ITEM, t.membership.filter("label < 9")).select("item", "label", r6("p"))


UNCERTAINTY_SQL = """
    SELECT item, round(-sum(p * log2(p)), 6) + 0.0 AS entropy_bits, round(pow(2, -sum(p * log2(p))), 6) AS effective_labels,
      count(*) AS nonzero, arg_min(label, (-p, label)) AS top_label, round(max(p), 6) AS top_p,
      round(sum(mass) / sum(support), 6) AS mean_conf FROM {src} GROUP BY item"""


@query("item_uncertainty_L4", uses="soft", sql=UNCERTAINTY_SQL.format(src="soft"))
def item_uncertainty(t: Tables) -> DataFrame:
    u = sl.item_uncertainty(t.soft, ITEM)
    return u.select("item", r6("entropy_bits"), r6("effective_labels"), "nonzero", "top_label", r6("top_p"), r6("mean_conf"))


@query("item_uncertainty_bulk_L4", sql="""
    SELECT l_orderkey, round(-sum(p * log2(p)), 6) + 0.0 AS entropy_bits, count(*) AS nonzero,
      arg_min(label, (-p, label)) AS top_label, round(max(p), 6) AS top_p FROM (
      SELECT l_orderkey, label, mass / sum(mass) OVER (PARTITION BY l_orderkey) AS p FROM (
        SELECT l_orderkey, l_returnflag || l_linestatus AS label, sum(1 + l_quantity::bigint % 5)::double AS mass
        FROM lineitem GROUP BY 1, 2)) GROUP BY l_orderkey""")
def item_uncertainty_bulk(t: Tables) -> DataFrame:
    u = sl.item_uncertainty(sl.soft_labels(bulk_votes(t), ["l_orderkey"]), ["l_orderkey"])
    return u.select("l_orderkey", r6("entropy_bits"), "nonzero", "top_label", r6("top_p"))


@query("canonical_table_L5", uses="soft", sql="""
    SELECT item, label, round(p, 6) AS p, support, round(row_conf, 6) AS row_conf,
      round(-sum(p * log2(p)) OVER i, 6) + 0.0 AS entropy_bits, count(*) OVER i AS nonzero,
      first(label) OVER (PARTITION BY item ORDER BY p DESC, label) AS top_label, round(max(p) OVER i, 6) AS top_p,
      round(sum(mass) OVER i / sum(support) OVER i, 6) AS mean_conf,
      row_number() OVER (PARTITION BY item ORDER BY p DESC, label) AS label_rank
    FROM soft WINDOW i AS (PARTITION BY item)""")
def canonical_table(t: Tables) -> DataFrame:
    c = sl.canonical_table(t.soft, ITEM)
    return c.select("item", "label", r6("p"), "support", r6("row_conf"), r6("entropy_bits"), "nonzero", "top_label",
                    r6("top_p"), r6("mean_conf"), "label_rank")


@query("observed_counts_L6", uses="votes soft", sql="""
    SELECT label, sum(support)::bigint AS observed FROM soft
    WHERE item IN (SELECT item FROM votes WHERE split = 'train') GROUP BY label""")
def observed_counts(t: Tables) -> DataFrame:
    train = sl.soft_labels(t.votes.filter("split = 'train'"), ITEM)
    return sl.observed_counts(train)


AGREEMENT_SQL = """
    SELECT {key}, string_agg(n::varchar, '-' ORDER BY n DESC) AS pattern,
      CASE WHEN max(n) >= 4 THEN '4_of_4' WHEN max(n) = 3 THEN '3_of_4' WHEN max(n) = 2 THEN '2_of_4'
           ELSE 'all_different' END AS bucket, max(n) AS majority_count,
      string_agg(label::varchar, ',' ORDER BY label) FILTER (WHERE n = mx) AS majority_labels,
      count(*) AS unique_labels, sum(n)::bigint AS vote_count
    FROM (SELECT *, max(n) OVER (PARTITION BY {key}) AS mx FROM ({counts})) GROUP BY {key}"""
VOTE_COUNTS = "SELECT item, label, count(*) AS n FROM votes GROUP BY item, label"
BULK_COUNTS = "SELECT l_orderkey, l_returnflag || l_linestatus AS label, count(*) AS n FROM lineitem GROUP BY 1, 2"


@query("agreement_L7", uses="votes", sql=AGREEMENT_SQL.format(key="item", counts=VOTE_COUNTS))
def agreement(t: Tables) -> DataFrame:
    return sl.agreement(t.votes, ITEM)


@query("agreement_bulk_L7", sql=AGREEMENT_SQL.format(key="l_orderkey", counts=BULK_COUNTS))
def agreement_bulk(t: Tables) -> DataFrame:
    return sl.agreement(bulk_votes(t), ["l_orderkey"])


@query("rounded_soft_label_L8", uses="soft", sql="""
    SELECT item, round(round(-sum(r * log2(r)), 8), 6) + 0.0 AS entropy_rounded, max(r) AS top_p_rounded
    FROM (SELECT item, round(p, 8) AS r FROM soft) GROUP BY item""")
def rounded_soft_label(t: Tables) -> DataFrame:
    return sl.rounded_soft_labels(t.votes, ITEM).select("item", r6("entropy_rounded"), "top_p_rounded")


def agreement_items(t: Tables) -> DataFrame:
    a = sl.agreement(t.votes, ITEM)
    u = sl.item_uncertainty(t.soft, ITEM).select("item", F.col("entropy_bits").alias("entropy"), "top_p")
    joined = a.join(u, "item").join(t.turns.select("item", "split", "role"), "item")
    return joined.withColumn("majority_fraction", F.col("majority_count") / F.col("vote_count"))


ITEM_STATS = f"""
    a AS ({AGREEMENT_SQL.format(key="item", counts=VOTE_COUNTS)}),
    u AS (SELECT item, -sum(p * log2(p)) AS entropy, max(p) AS top_p FROM soft GROUP BY item),
    x AS (SELECT a.*, u.entropy, u.top_p, t.split, t.role, majority_count / vote_count AS majority_fraction
          FROM a JOIN u USING (item) JOIN turns t USING (item))"""


@query("agreement_rollup_L9", uses="votes soft turns", sql=f"""
    WITH {ITEM_STATS}
    SELECT coalesce(split, 'all') AS split, coalesce(role, 'all') AS role, count(*) AS n,
      count(*) FILTER (WHERE bucket = '4_of_4') AS n_4_of_4, count(*) FILTER (WHERE bucket = '3_of_4') AS n_3_of_4,
      count(*) FILTER (WHERE bucket = '2_of_4') AS n_2_of_4,
      count(*) FILTER (WHERE bucket = 'all_different') AS n_all_different,
      round(count(*) FILTER (WHERE bucket = '2_of_4') / count(*), 6) AS rate_2_of_4,
      round(avg(entropy), 6) AS mean_entropy, round(avg(majority_fraction), 6) AS mean_majority,
      round(avg(top_p), 6) AS mean_top_p, round(avg(unique_labels), 6) AS mean_unique,
      round(median(entropy), 6) AS median_entropy
    FROM x GROUP BY CUBE (split, role)""")
def agreement_rollup(t: Tables) -> DataFrame:
    r = sl.agreement_rollup(agreement_items(t))
    return r.select("split", "role", "n", *["n_" + b for b in sl.BUCKETS], r6("rate_2_of_4"), r6("mean_entropy"),
                    r6("mean_majority"), r6("mean_top_p"), r6("mean_unique"), r6("median_entropy"))


@query("pattern_rates_L9", uses="votes soft turns", sql=f"""
    WITH {ITEM_STATS}
    SELECT split, pattern, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY split), 6) AS rate
    FROM x GROUP BY split, pattern""")
def pattern_rates(t: Tables) -> DataFrame:
    return sl.pattern_rates(agreement_items(t)).select("split", "pattern", "n", r6("rate"))


@query("complete_items_L10", uses="votes", sql="""
    SELECT item, count(DISTINCT annotator) FILTER (WHERE confidence < 5) >= 4 AS complete FROM votes GROUP BY item""")
def complete_items(t: Tables) -> DataFrame:
    votes = t.votes.withColumn("confidence", F.when(F.col("confidence") < 5, F.col("confidence")))
    return sl.complete_items(votes, ITEM, 4)


@query("complete_items_bulk_L10", sql="""
    SELECT complete, count(*) AS items FROM (
      SELECT l_orderkey, count(DISTINCT l_linenumber) >= 4 AS complete FROM lineitem GROUP BY l_orderkey) GROUP BY complete""")
def complete_items_bulk(t: Tables) -> DataFrame:
    done = sl.complete_items(bulk_votes(t), ["l_orderkey"], 4)
    return done.groupBy("complete").agg(F.count(F.lit(1)).alias("items"))


@query("pool_check_L11", uses="votes", sql=f"""
    WITH o AS (SELECT DISTINCT label FROM votes WHERE split = 'test' AND turn = 1)
    SELECT l AS label, l < 20 AS in_pool, o.label IS NOT NULL AS is_observed, l < 20 AND o.label IS NULL AS zero_frequency,
      l >= 4 AND l < 20 AND o.label IS NULL AS clustered_zero, l >= 20 AS clustered_outside_pool
    FROM range(0, {LABELS}) r(l) LEFT JOIN o ON o.label = l""")
def pool_check(t: Tables) -> DataFrame:
    obs = sl.observed_counts(sl.soft_labels(t.votes.filter("split = 'test' AND turn = 1"), ITEM))
    return sl.pool_check(t.membership.filter("label < 20"), obs, t.membership.filter("label >= 4"))


@query("annotator_labels_L12", uses="votes", sql="""
    SELECT item, string_agg(label::varchar, ',' ORDER BY annotator) AS labels, any_value(bucket) AS bucket FROM (
      SELECT item, label, annotator, CASE max(n) OVER (PARTITION BY item) WHEN 1 THEN 'all_different' WHEN 2 THEN '2_of_4'
        WHEN 3 THEN '3_of_4' ELSE '4_of_4' END AS bucket
      FROM (SELECT *, count(*) OVER (PARTITION BY item, label) AS n FROM votes)) GROUP BY item""")
def annotator_labels(t: Tables) -> DataFrame:
    a = sl.annotator_labels(t.votes, ITEM)
    text = F.array_join(F.transform("labels", lambda x: x.cast("string")), ",")
    return a.select("item", text.alias("labels"), "bucket")


@query("mass_check_Q1", uses="soft", sql="""
    SELECT count(*) AS groups, count(*) FILTER (WHERE abs(s - 1) > 1e-8) AS failed, round(max(abs(s - 1)), 6) AS max_error
    FROM (SELECT item, sum(CASE WHEN label = 3 THEN p / 2 ELSE p END) AS s FROM soft GROUP BY item)""")
def mass_check(t: Tables) -> DataFrame:
    bent = t.soft.withColumn("p", F.when(F.col("label") == 3, F.col("p") / 2).otherwise(F.col("p")))
    return Q.mass_summary(bent, ITEM).select("groups", "failed", r6("max_error"))


@query("mass_errors_Q1", uses="soft", sql="""
    SELECT item, round(sum(CASE WHEN label = 3 THEN p / 2 ELSE p END), 6) AS mass FROM soft GROUP BY item
    HAVING abs(sum(CASE WHEN label = 3 THEN p / 2 ELSE p END) - 1) > 1e-8""")
def mass_errors(t: Tables) -> DataFrame:
    bent = t.soft.withColumn("p", F.when(F.col("label") == 3, F.col("p") / 2).otherwise(F.col("p")))
    return Q.mass_errors(bent, ITEM).select("item", r6("mass"))


@query("missing_keys_Q2", uses="soft regional", sql="""
    SELECT DISTINCT item, label % 6 AS region FROM soft EXCEPT SELECT item, region FROM regional WHERE p > 0.2""")
def missing_keys(t: Tables) -> DataFrame:
    expected = t.soft.select("item", (F.col("label") % 6).alias("region"))
    return Q.missing_keys(expected, t.regional.filter("p > 0.2"), ["item", "region"])
