"""Queries for membership and projection (P), sequences (W), transitions (T) and the remaining checks (Q)."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dist as D
from ..functions import ranking
from ..functions.keys import hash60
from ..operators import membership as mem
from ..operators import quality as Q
from ..operators import sequence as seq
from ..operators import similarity as sim
from ..operators import softlabel as sl
from ..operators import transition as tr
from .fixtures import CTES, ITEM, LABELS, REGIONS, Tables, r6
from .registry import query

LN_C = f"ln({REGIONS}.0::double)"
CTES.update({
    # Items with entropy (nats) and reliability.
    "uncertain": ("regional item_conf", f"""
        SELECT item, entropy, nonzero, top_region, top_p, least(1, greatest(0, entropy / {LN_C})) AS norm_entropy,
          least(1, greatest(0, mean_conf / 5 * least(1, greatest(0, 1 - entropy / {LN_C})))) AS reliability
        FROM (SELECT item, -sum(p * ln(p)) AS entropy, count(*) AS nonzero, arg_min(region, (-p, region)) AS top_region,
                max(p) AS top_p FROM regional GROUP BY item) JOIN item_conf USING (item)"""),
    "counts": ("pairs regional uncertain", """
        SELECT pair, s.region AS source, t.region AS target, sum(s.p * t.p) AS n,
          sum(s.p * t.p * sqrt(greatest(0, us.reliability * ut.reliability))) AS wn
        FROM pairs JOIN regional s ON s.item = s_item JOIN regional t ON t.item = t_item
        JOIN uncertain us ON us.item = s_item JOIN uncertain ut ON ut.item = t_item GROUP BY ALL"""),
    "grid": ("", f"""
        SELECT pair, source, target FROM (SELECT unnest(['A2B','B2A','A2A','B2B']) AS pair)
        CROSS JOIN (SELECT unnest(range(0, {REGIONS})) AS source) CROSS JOIN (SELECT unnest(range(0, {REGIONS})) AS target)"""),
    "full_counts": ("counts grid", """
        SELECT pair, source, target, coalesce(wn, 0) AS wn, coalesce(n, 0) AS n FROM grid LEFT JOIN counts USING (pair, source, target)"""),
    "conds": ("full_counts", f"""
        SELECT pair, source, target, n, wn, (wn + 0.1::double) / (sum(wn) OVER s + 0.1::double * {REGIONS}) AS cond,
          (n + 0.1::double) / (sum(n) OVER s + 0.1::double * {REGIONS}) AS cond_plain,
          sum(wn) OVER s / sum(wn) OVER a AS source_marginal, sum(wn) OVER t / sum(wn) OVER a AS target_marginal
        FROM full_counts WINDOW s AS (PARTITION BY pair, source), t AS (PARTITION BY pair, target), a AS (PARTITION BY pair)"""),
    "local_sim": ("membership label_vectors", """
        SELECT a.region, a.label, b.label AS nb, greatest(-1, least(1, coalesce(c.d / sqrt(na.s * nb2.s), 0))) AS sim,
          count(*) OVER (PARTITION BY a.region, a.label) AS size
        FROM membership a JOIN membership b ON a.region = b.region
        JOIN (SELECT x.label AS l1, y.label AS l2, sum(x.x * y.x) AS d FROM label_vectors x JOIN label_vectors y USING (d)
              GROUP BY ALL) c ON c.l1 = a.label AND c.l2 = b.label
        JOIN (SELECT label, sum(x * x) AS s FROM label_vectors GROUP BY 1) na ON na.label = a.label
        JOIN (SELECT label, sum(x * x) AS s FROM label_vectors GROUP BY 1) nb2 ON nb2.label = b.label"""),
    "local_near": ("local_sim", """
        SELECT *, exp((sim - max(sim) OVER w) / 0.15::double) / sum(exp((sim - mx) / 0.15::double)) OVER w AS weight FROM (
          SELECT *, max(sim) OVER (PARTITION BY region, label) AS mx FROM (
            SELECT *, row_number() OVER (PARTITION BY region, label ORDER BY (nb <> label)::int, round(sim, 9) DESC, nb) AS rank
            FROM local_sim) WHERE rank <= 5) WINDOW w AS (PARTITION BY region, label)"""),
    "local_vec": ("local_near label_vectors", """
        SELECT region, n.label, d, sum(weight * v.x) AS x FROM local_near n JOIN label_vectors v ON v.label = n.nb GROUP BY ALL"""),
    "local_stats": ("local_vec label_vectors local_near", """
        SELECT region, label, sqrt(sum((l.x - g.x) * (l.x - g.x))) AS l2_delta,
          sum(l.x * g.x) / sqrt(sum(l.x * l.x) * sum(g.x * g.x)) AS cosine, any_value(k.neighbours) AS neighbours,
          any_value(k.labels) AS neighbour_labels
        FROM local_vec l JOIN label_vectors g USING (label, d)
        JOIN (SELECT region, label, count(*) AS neighbours, string_agg(nb::varchar, ',' ORDER BY rank) AS labels
              FROM local_near GROUP BY ALL) k USING (region, label) GROUP BY region, label"""),
    "contrib": ("soft membership", """
        SELECT item, region, label, p * m AS w, sum(p * m) OVER (PARTITION BY item, region) AS r
        FROM soft JOIN membership USING (label)"""),
    "supports": ("votes", """
        SELECT label, (label + annotator) % 6 AS region, max(confidence)::double AS support FROM votes
        WHERE label % 4 <> 0 AND confidence > 2 GROUP BY ALL"""),
    "support_rows": ("supports votes", """
        SELECT label, region, raw, sharp_w / sum(sharp_w) OVER (PARTITION BY label) AS sharp, support, n,
          CASE WHEN n > 1 THEN 'soft_candidate' ELSE 'onehot' END AS source_type FROM (
          SELECT *, pow(raw, 1 / 0.7::double) AS sharp_w, count(*) OVER (PARTITION BY label) AS n FROM (
            SELECT *, coalesce(support, 1) / sum(coalesce(support, 1)) OVER (PARTITION BY label) AS raw FROM (
              SELECT label, region, support FROM supports
              UNION ALL
              SELECT l.label, l.label % 6, (SELECT max(support) FROM supports s WHERE s.label = l.label)
              FROM (SELECT DISTINCT label FROM votes) l
              WHERE NOT EXISTS (SELECT 1 FROM supports s WHERE s.label = l.label AND s.region = l.label % 6))))"""),
    "sharp_membership": ("membership", """
        SELECT label, region, pow(m, 1 / 0.7::double) / sum(pow(m, 1 / 0.7::double)) OVER (PARTITION BY label) AS m FROM membership"""),
})


# ---- membership and projection ---------------------------------------------------------------------------

@query("region_projection_P1", uses="regional", sql="SELECT item, region, round(p, 6) AS p FROM regional")
def region_projection(t: Tables) -> DataFrame:
    return t.regional.select("item", "region", r6("p"))


@query("missing_mass_P1", uses="soft", sql="""
    SELECT label, round(sum(p), 6) AS missing_mass FROM soft WHERE label >= 20 GROUP BY label""")
def missing_mass(t: Tables) -> DataFrame:
    return mem.missing_mass(t.soft, t.membership.filter("label < 20")).select("label", r6("missing_mass"))


@query("complete_projection_P1", uses="soft membership", sql="""
    WITH known AS (SELECT * FROM membership WHERE label < 20), bad AS (SELECT DISTINCT item FROM soft WHERE label NOT IN (SELECT label FROM known) AND p > 0)
    SELECT item, region, round(p / sum(p) OVER (PARTITION BY item), 6) AS p FROM (
      SELECT item, region, sum(p * m) AS p FROM soft JOIN known USING (label) WHERE item NOT IN (SELECT item FROM bad) GROUP BY item, region)""")
def complete_projection(t: Tables) -> DataFrame:
    """Items with a label outside the membership are left out."""
    return mem.project_complete(t.soft, t.membership.filter("label < 20"), ITEM).select("item", "region", r6("p"))


@query("projection_rejects_P1", uses="soft", sql="""
    SELECT item, count(*) AS missing_labels, round(sum(p), 6) AS missing_mass FROM soft WHERE label >= 20 GROUP BY item""")
def projection_rejects(t: Tables) -> DataFrame:
    return mem.projection_rejects(t.soft, t.membership.filter("label < 20"), ITEM).select("item", "missing_labels", r6("missing_mass"))


@query("item_vector_P2", uses="soft label_vectors", sql="""
    SELECT item, d::int AS d, round(sum(p * x), 9) + 0.0 AS z FROM soft JOIN label_vectors USING (label) GROUP BY item, d""")
def item_vector(t: Tables) -> DataFrame:
    z = mem.item_vectors(t.soft, t.label_vectors, ITEM, 4)
    return z.select("item", F.posexplode("z").alias("d", "z")).select("item", "d", (F.round("z", 9) + F.lit(0.0)).alias("z"))


def uncertain(t: Tables) -> DataFrame:
    return mem.region_uncertainty(t.regional, ITEM, REGIONS, t.item_conf)


@query("region_uncertainty_P3", uses="uncertain", sql="""
    SELECT item, round(entropy, 6) + 0.0 AS entropy, round(norm_entropy, 6) + 0.0 AS norm_entropy, top_region,
      round(top_p, 6) AS top_p, nonzero, round(reliability, 6) AS reliability
    FROM (SELECT u.* EXCLUDE (top_region), r.top_region FROM uncertain u JOIN (
      SELECT item, arg_min(region, (-round(p, 9), region)) AS top_region FROM regional GROUP BY item) r USING (item))""")
def region_uncertainty(t: Tables) -> DataFrame:
    rounded = t.regional.withColumn("p", F.round("p", 9))
    top = mem.region_uncertainty(rounded, ITEM, REGIONS, t.item_conf).select("item", "top_region")
    u = uncertain(t).drop("top_region").join(top, "item")
    return u.select("item", r6("entropy"), r6("norm_entropy"), "top_region", r6("top_p"), "nonzero", r6("reliability"))


def local_table(t: Tables) -> DataFrame:
    return mem.local_vectors(t.membership, t.label_vectors, None, 4)


def conditioned(t: Tables) -> DataFrame:
    local = local_table(t).select("label", "region", F.col("local_vector").alias("v"))
    return mem.conditioned_vectors(t.soft, t.membership, local, ITEM, 4)


CONTRIB_SQL = """
    v AS (SELECT item, region, sqrt(sum(x * x)) AS vector_norm, max(x) FILTER (WHERE d = 0) AS v0 FROM (
        SELECT item, c.region, d, sum(w * x) / (any_value(r) + 1e-12) AS x
        FROM contrib c JOIN local_vec l ON l.label = c.label AND l.region = c.region GROUP BY ALL) GROUP BY item, region),
    c AS (SELECT item, region, any_value(r) AS r, count(*) AS contributors,
        -sum(w / (r + 1e-12) * ln(w / (r + 1e-12))) AS contribution_entropy,
        list(label ORDER BY round(w, 9) DESC, label)[1:3] AS labels,
        list(w / (r + 1e-12) ORDER BY round(w, 9) DESC, label)[1] AS w1 FROM contrib GROUP BY item, region)"""


@query("conditioned_vectors_P4", uses="contrib local_vec", sql=f"""
    WITH {CONTRIB_SQL}
    SELECT item, region, round(r, 6) AS r, contributors, round(contribution_entropy, 6) + 0.0 AS contribution_entropy,
      round(v0, 6) + 0.0 AS v0, round(vector_norm, 6) AS vector_norm, round(w1, 6) AS w1,
      array_to_string(list_sort(labels), ',') AS top_labels FROM c JOIN v USING (item, region)""")
def conditioned_vectors(t: Tables) -> DataFrame:
    c = conditioned(t)
    labels = F.array_join(F.transform(F.sort_array("top_labels"), lambda x: x.cast("string")), ",")
    return c.select("item", "region", r6("r"), "contributors", r6("contribution_entropy"),
                    r6(F.element_at("vector", 1), "v0"), r6("vector_norm"), r6(F.element_at("top_weights", 1), "w1"),
                    labels.alias("top_labels"))


@query("projection_summary_P5", uses="uncertain turns", sql="""
    SELECT count(*) AS items, sum(nonzero)::bigint AS item_region_pairs, round(avg(nonzero), 6) AS avg_nonzero,
      round(avg(entropy), 6) AS avg_entropy, round(avg(top_p), 6) AS avg_top_p,
      round(avg(entropy) FILTER (WHERE role = 'A'), 6) AS a_entropy, round(avg(entropy) FILTER (WHERE role = 'B'), 6) AS b_entropy,
      round(avg(top_p) FILTER (WHERE role = 'A'), 6) AS a_top_p, round(avg(top_p) FILTER (WHERE role = 'B'), 6) AS b_top_p,
      avg(entropy) FILTER (WHERE role = 'B') < avg(entropy) FILTER (WHERE role = 'A')
        AND avg(top_p) FILTER (WHERE role = 'B') > avg(top_p) FILTER (WHERE role = 'A') AS b_more_concentrated
    FROM uncertain JOIN turns USING (item)""")
def projection_summary(t: Tables) -> DataFrame:
    s = mem.projection_summary(uncertain(t).join(t.turns.select("item", "role"), "item"))
    return s.select("items", "item_region_pairs", *[r6(c) for c in (
        "avg_nonzero", "avg_entropy", "avg_top_p", "a_entropy", "b_entropy", "a_top_p", "b_top_p")], "b_more_concentrated")


def support_membership(t: Tables) -> DataFrame:
    cand = t.votes.filter("label % 4 <> 0 AND confidence > 2").groupBy(
        "label", ((F.col("label") + F.col("annotator")) % 6).alias("region")
    ).agg(F.max("confidence").cast("double").alias("support"))
    primaries = t.votes.select("label").distinct().withColumn("primary", F.col("label") % 6)
    return mem.from_supports(cand, primaries)


@query("membership_from_supports_P6", uses="support_rows", sql="""
    SELECT label, region, round(raw, 6) AS raw, round(sharp, 6) AS sharp, source_type, support FROM support_rows""")
def membership_from_supports(t: Tables) -> DataFrame:
    return support_membership(t).select("label", "region", r6("raw"), r6("sharp"), "source_type", "support")


@query("ambiguous_labels_P7", uses="support_rows soft", sql="""
    SELECT label, round(h, 6) AS entropy_bits, regions, observed, memberships FROM (
      SELECT label, round(-sum(raw * log2(raw)), 9) + 0.0 AS h, count(*) AS regions, any_value(observed) AS observed,
        string_agg(printf('%d:%.4f', region, raw), ', ' ORDER BY raw DESC, region::varchar) AS memberships
      FROM support_rows JOIN (SELECT label, sum(support)::bigint AS observed FROM soft GROUP BY label) USING (label) GROUP BY label)
    ORDER BY h DESC, regions DESC, observed DESC, label LIMIT 10""")
def ambiguous_labels(t: Tables) -> DataFrame:
    rows = support_membership(t).join(sl.observed_counts(t.soft), "label")
    return mem.ambiguous_labels(rows, 10).select("label", r6("entropy_bits"), "regions", "observed", "memberships")


@query("membership_summary_P8", uses="support_rows", sql="""
    SELECT count(*) AS labels, count(*) FILTER (WHERE n = 1) AS onehot_labels, count(*) FILTER (WHERE n > 1) AS soft_labels,
      round(avg(n), 6) AS regions_per_label, round(max(abs(r - 1)), 6) AS max_raw_error, round(max(abs(s - 1)), 6) AS max_sharp_error
    FROM (SELECT label, count(*) AS n, sum(raw) AS r, sum(sharp) AS s FROM support_rows GROUP BY label)""")
def membership_summary(t: Tables) -> DataFrame:
    s = mem.membership_summary(support_membership(t))
    return s.select("labels", "onehot_labels", "soft_labels", r6("regions_per_label"), r6("max_raw_error"), r6("max_sharp_error"))


@query("boundary_candidates_P9", uses="label_vectors membership", sql="""
    WITH cosines AS (SELECT x.label AS src, y.label AS dst, sum(x.x * y.x) / sqrt(sum(x.x * x.x) * sum(y.x * y.x)) AS w
      FROM label_vectors x JOIN label_vectors y USING (d) WHERE x.label <> y.label GROUP BY ALL),
    own AS (SELECT label, arg_min(region, (-m, region)) AS region FROM membership GROUP BY label),
    sup AS (SELECT src, region, max(w) AS support FROM cosines JOIN own ON own.label = dst GROUP BY ALL),
    s AS (SELECT sup.*, o.region AS own, coalesce(max(CASE WHEN sup.region = o.region THEN support END)
            OVER (PARTITION BY src), 0) AS own_support FROM sup JOIN own o ON o.label = src),
    cr AS (SELECT src, region, support, 1 AS k FROM s WHERE region <> own AND support >= greatest(0.7, own_support * 0.85)),
    u AS (SELECT DISTINCT src, own AS region, own_support AS support, 0 AS k FROM s WHERE src IN (SELECT src FROM cr)
          UNION ALL SELECT * FROM cr)
    SELECT src AS label, region, round(support, 6) AS support, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY src ORDER BY k, support DESC, region) AS rank FROM u) WHERE rank <= 4""")
def boundary_candidates(t: Tables) -> DataFrame:
    own = mem.top_region(t.membership)
    return mem.boundary_candidates(label_cosines(t), own).select("label", "region", r6("support"), "rank")


def label_cosines(t: Tables) -> DataFrame:
    """Cosine of every ordered pair of labels."""
    long = t.label_vectors.select("label", F.posexplode("v").alias("bucket", "x"))
    return sim.context_similarity(long, "x", clip=False)


def sharp(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    powered = F.pow("m", F.lit(1 / 0.7))
    return t.membership.withColumn("m", powered / F.sum(powered).over(Window.partitionBy("label")))


def representation_rows(t: Tables) -> DataFrame:
    return mem.representations(t.soft, {"raw": t.membership, "sharp": sharp(t)}, t.votes, ITEM)


BUCKET_CASE = """CASE max(n) WHEN 1 THEN 'all_different' WHEN 2 THEN '2_of_4' WHEN 3 THEN '3_of_4' ELSE '4_of_4' END"""
REPRESENTATION_SQL = f"""
    lb AS (SELECT item, {BUCKET_CASE} AS bucket FROM (SELECT item, label, count(*) AS n FROM votes GROUP BY ALL) GROUP BY item),
    rb AS (SELECT item, {BUCKET_CASE} AS bucket FROM (SELECT item, region, count(*) AS n FROM votes JOIN (
        SELECT label, arg_min(region, (-m, region)) AS region FROM membership GROUP BY label) USING (label) GROUP BY ALL) GROUP BY item),
    base AS (SELECT item, 'label' AS representation, -sum(p * log2(p)) AS h, max(p) AS tp, count(*) AS nonzero FROM soft GROUP BY item),
    regs AS (SELECT item, representation, -sum(p * log2(p)) AS h, max(p) AS tp, count(*) AS nonzero FROM (
        SELECT item, 'raw' AS representation, p FROM regional UNION ALL
        SELECT item, 'sharp', sum(p * m) FROM soft JOIN sharp_membership s USING (label) GROUP BY item, s.region) GROUP BY ALL),
    reps AS (SELECT b.*, lb.bucket, lb.bucket AS label_bucket, 0.0::double AS dh, 0.0::double AS dt FROM base b JOIN lb USING (item)
        UNION ALL SELECT r.*, rb.bucket, lb.bucket, r.h - b.h, r.tp - b.tp FROM regs r JOIN rb USING (item) JOIN lb USING (item)
        JOIN base b USING (item))"""


@query("representations_P10", uses="votes membership sharp_membership regional soft", sql=f"""
    WITH {REPRESENTATION_SQL}
    SELECT item, representation, round(h, 6) + 0.0 AS entropy_bits, round(tp, 6) AS top_p, nonzero, bucket, label_bucket,
      round(dh, 6) + 0.0 AS d_entropy, round(dt, 6) + 0.0 AS d_top FROM reps""")
def representations(t: Tables) -> DataFrame:
    return representation_rows(t).select("item", "representation", r6("entropy_bits"), r6("top_p"), "nonzero", "bucket",
                                         "label_bucket", r6("d_entropy"), r6("d_top"))


STABILITY_SQL = """
    ranks AS (SELECT *, CASE bucket WHEN '4_of_4' THEN 4 WHEN '3_of_4' THEN 3 WHEN '2_of_4' THEN 2 ELSE 1 END
      - CASE label_bucket WHEN '4_of_4' THEN 4 WHEN '3_of_4' THEN 3 WHEN '2_of_4' THEN 2 ELSE 1 END AS up FROM reps)"""


@query("stability_aggregate_P11", uses="votes membership sharp_membership regional soft turns", sql=f"""
    WITH {REPRESENTATION_SQL}, {STABILITY_SQL}
    SELECT role AS group_value, representation, count(*) AS items, round(avg(h), 6) AS mean_entropy, round(avg(tp), 6) AS mean_top_p,
      round(avg(dh), 6) + 0.0 AS mean_d_entropy,
      CASE WHEN representation <> 'label' THEN round(avg((up > 0)::int), 6) END AS improved_rate,
      CASE WHEN representation <> 'label' THEN round(avg((up < 0)::int), 6) END AS degraded_rate,
      count(*) FILTER (WHERE bucket = '3_of_4') AS n_3_of_4, round(avg((bucket = '3_of_4')::int), 6) AS rate_3_of_4
    FROM ranks JOIN turns USING (item) GROUP BY role, representation""")
def stability_aggregate(t: Tables) -> DataFrame:
    rows = representation_rows(t).join(t.turns.select("item", "role"), "item")
    a = mem.stability_aggregate(rows, "role")
    return a.select("group_value", "representation", "items", r6("mean_entropy"), r6("mean_top_p"), r6("mean_d_entropy"),
                    r6("improved_rate"), r6("degraded_rate"), "n_3_of_4", r6("rate_3_of_4"))


@query("recommendation_P12", uses="votes membership sharp_membership regional soft", sql=f"""
    WITH {REPRESENTATION_SQL}, {STABILITY_SQL},
    a AS (SELECT representation AS r, avg(h) AS h, avg(tp) AS tp, avg((up < 0)::int) AS dg FROM ranks GROUP BY 1),
    o AS (SELECT max(h) FILTER (r = 'label') AS lh, max(h) FILTER (r = 'raw') AS rh, max(h) FILTER (r = 'sharp') AS sh,
      max(tp) FILTER (r = 'label') AS lt, max(tp) FILTER (r = 'raw') AS rt, max(tp) FILTER (r = 'sharp') AS st,
      max(dg) FILTER (r = 'raw') AS rd, max(dg) FILTER (r = 'sharp') AS sd FROM a)
    SELECT CASE WHEN rh - sh > 0.02 AND st - rt > 0.005 AND sd <= rd + 0.005 THEN 'sharpened' ELSE 'raw' END AS recommended,
      lh - rh > 0 AND rt - lt > 0 AND (rh <= sh + 1e-9 OR abs(st - rt) < 0.002) AS use_raw FROM o""")
def recommendation(t: Tables) -> DataFrame:
    return mem.recommend(mem.stability_aggregate(representation_rows(t)))


@query("local_vectors_P13", uses="local_stats", sql="""
    SELECT region, label, round(l2_delta, 6) AS l2_delta, round(cosine, 6) AS cosine, neighbours, neighbour_labels FROM local_stats""")
def local_vectors(t: Tables) -> DataFrame:
    l = local_table(t)
    names = F.array_join(F.transform("neighbour_labels", lambda x: x.cast("string")), ",").alias("neighbour_labels")
    return l.select("region", "label", r6("l2_delta"), r6("cosine"), "neighbours", names)


def local_with_counts(t: Tables) -> DataFrame:
    kind = t.membership.groupBy("label").agg(
        F.when(F.count(F.lit(1)) > 1, "soft_candidate").otherwise("onehot").alias("source_type")
    )
    return local_table(t).join(kind, "label").join(sl.observed_counts(t.soft), "label")


LOCAL_COUNTS_SQL = """
    x AS (SELECT s.*, m.m, k.n, o.observed FROM local_stats s JOIN membership m USING (region, label)
      JOIN (SELECT label, count(*) AS n FROM membership GROUP BY label) k USING (label)
      JOIN (SELECT label, sum(support)::bigint AS observed FROM soft GROUP BY label) o USING (label) WHERE k.n > 1)"""


@query("frequent_ambiguous_P14", uses="local_stats membership soft", sql=f"""
    WITH {LOCAL_COUNTS_SQL} SELECT region, label, observed, round(m, 6) AS m FROM x ORDER BY observed DESC, round(m, 9) DESC, label, region LIMIT 12""")
def frequent_ambiguous(t: Tables) -> DataFrame:
    return mem.frequent_ambiguous(local_with_counts(t)).select("region", "label", "observed", r6("m"))


@query("largest_changes_P14", uses="local_stats membership soft", sql=f"""
    WITH {LOCAL_COUNTS_SQL} SELECT region, label, round(l2_delta, 6) AS l2_delta FROM x ORDER BY round(l2_delta, 9) DESC, label, region LIMIT 8""")
def largest_changes(t: Tables) -> DataFrame:
    return mem.largest_changes(local_with_counts(t)).select("region", "label", r6("l2_delta"))


@query("most_mixed_P15", uses="contrib", sql="""
    SELECT item, region, round(e, 6) AS contribution_entropy, round(r, 6) AS r FROM (
      SELECT item, region, any_value(r) AS r, count(*) AS n, -sum(w / (r + 1e-12) * ln(w / (r + 1e-12))) AS e
      FROM contrib GROUP BY item, region) WHERE n > 1 AND e > 0 ORDER BY round(e, 9) DESC, round(r, 9) DESC, item, region LIMIT 20""")
def most_mixed(t: Tables) -> DataFrame:
    return mem.most_mixed(conditioned(t), ITEM, 20).select("item", "region", r6("contribution_entropy"), r6("r"))


# ---- sequences -------------------------------------------------------------------------------------------

@query("next_turn_features_W1", uses="turns", sql="""
    SELECT item, lead(role) OVER w AS next_role, role || '2' || lead(role) OVER w AS role_pair,
      role || '2' || lead(role, 2) OVER w AS lag2_role_pair, lead(role) OVER w IS NULL AS is_last_turn,
      lead(item) OVER w AS next_item FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def next_turn_features(t: Tables) -> DataFrame:
    f = seq.next_turn_features(t.turns, ["split", "conv_id"], "turn", ["item"])
    return f.select("item", "next_role", "role_pair", "lag2_role_pair", "is_last_turn", "next_item")


@query("next_votes_W1", uses="votes", sql="""
    SELECT item, annotator, lead(label) OVER w AS next_label, lead(confidence) OVER w AS next_confidence
    FROM votes WINDOW w AS (PARTITION BY conv_id, annotator ORDER BY turn)""")
def next_votes(t: Tables) -> DataFrame:
    f = seq.next_turn_features(t.votes, ["split", "conv_id", "annotator"], "turn", ["label", "confidence"])
    return f.select("item", "annotator", "next_label", "next_confidence")


@query("next_event_W1", sql="""
    SELECT event_id, pos, next_type, pair FROM (SELECT event_id, row_number() OVER w - 1 AS pos,
      lead(event_type) OVER w AS next_type, event_type || '2' || lead(event_type) OVER w AS pair
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""")
def next_event(t: Tables) -> DataFrame:
    # A user may own a third of all events: positions are ranked in day blocks, neighbours in position blocks.
    e = t.read("events").select("event_id", "user_id", "ts", F.col("event_type").alias("role"))
    ranked = ranking.positions(e, ["user_id"], ["ts", "event_id"], F.floor(F.unix_timestamp("ts") / 86400))
    f = seq.next_turn_features(ranked, ["user_id"], "pos")
    return f.select("event_id", "pos", F.col("next_role").alias("next_type"), F.col("role_pair").alias("pair"))


@query("adjacent_pairs_W2", uses="turns", sql="""
    SELECT * FROM (SELECT item, lead(item) OVER w AS next_item, md5(string_agg(role || ': ' || text, chr(10)) OVER
        (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) AS context_md5
      FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE next_item IS NOT NULL""")
def adjacent_pairs(t: Tables) -> DataFrame:
    a = seq.adjacent_pairs(t.turns, ["split", "conv_id"])
    return a.select("item", "next_item", F.md5("context").alias("context_md5"))


def item_space(t: Tables) -> DataFrame:
    z = mem.item_vectors(t.soft, t.label_vectors, ITEM, 4)
    d = t.dist.select("item", "dist")
    return d.join(z, "item").withColumn("entropy", D.entropy(F.col("dist")))


@query("prepared_pairs_W3", uses="turns dist soft label_vectors", sql="""
    WITH z AS (SELECT item, sqrt(sum(x * x)) AS zn FROM (SELECT item, d, sum(p * x) AS x FROM soft JOIN label_vectors
        USING (label) GROUP BY ALL) GROUP BY item),
    h AS (SELECT item, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) AS h, max(p) FILTER (region = 0) AS p0 FROM dist GROUP BY item)
    SELECT a.item, b.item AS next_item, a.role || '->' || b.role AS transition, round(ha.h, 6) + 0.0 AS source_entropy,
      round(hb.h, 6) + 0.0 AS target_entropy, round(hb.p0, 6) AS target_p0, round(za.zn, 6) AS source_norm
    FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
    JOIN h ha ON ha.item = a.item JOIN h hb ON hb.item = b.item JOIN z za ON za.item = a.item""")
def prepared_pairs(t: Tables) -> DataFrame:
    p = seq.prepared_pairs(seq.adjacent_pairs(t.turns, ["split", "conv_id"]), item_space(t))
    return p.select("item", "next_item", "transition", r6("source_entropy"), r6("target_entropy"),
                    r6(F.element_at("target_dist", 1), "target_p0"), r6(D.norm2(F.col("source_z")), "source_norm"))


@query("typed_pairs_W4", uses="pairs", sql="SELECT pair, s_item, t_item, lag FROM pairs")
def typed_pairs(t: Tables) -> DataFrame:
    return t.pairs.select("pair", "s_item", "t_item", "lag")


@query("prediction_instances_W5", uses="pairs turns regional", sql="""
    SELECT s_item, t_item, length(a.text) AS s_len, length(b.text) AS t_len, x.situation, round(r.p0, 6) AS t_p0
    FROM pairs JOIN turns a ON a.item = s_item JOIN turns b ON b.item = t_item
    LEFT JOIN (SELECT conv_id, length(text) AS situation FROM conversations WHERE role = 'system') x ON x.conv_id = pairs.conv_id
    JOIN (SELECT item, coalesce(max(p) FILTER (region = 0), 0) AS p0 FROM regional GROUP BY item) r ON r.item = t_item
    WHERE pair = 'A2B'""")
def prediction_instances(t: Tables) -> DataFrame:
    situ = t.read("conversations").filter("role = 'system'").select("conv_id", F.col("text").alias("situation"))
    situ = situ.join(t.turns.select("conv_id", "split").distinct(), "conv_id")
    p = seq.prediction_instances(t.pairs, t.dist.select("item", "dist"), t.turns, situ)
    return p.select("s_item", "t_item", F.length("s_text").cast("long").alias("s_len"),
                    F.length("t_text").cast("long").alias("t_len"),
                    F.length("situation").cast("long").alias("situation"), r6(F.element_at("t_dist", 1), "t_p0"))


@query("context_candidates_W6", uses="turns", sql="""
    SELECT a.item, count(*) AS n_previous, arg_max(b.role, b.turn) AS previous_role,
      arg_max(b.role, b.turn) || '->' || any_value(a.role) AS transition, sum(length(b.text))::bigint AS history_chars
    FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND b.turn < a.turn WHERE trim(b.text) <> '' AND trim(a.text) <> ''
    GROUP BY a.item""")
def context_candidates(t: Tables) -> DataFrame:
    c = seq.context_candidates(t.turns, ["split", "conv_id"])
    chars = F.aggregate("history", F.lit(0).cast("long"), lambda s, x: s + F.length(x["text"]))
    return c.select("item", F.size("history").cast("long").alias("n_previous"), "previous_role", "transition",
                    chars.alias("history_chars"))


@query("response_examples_W7", uses="turns", sql="""
    SELECT a.item, md5(string_agg(b.role || b.text, '|' ORDER BY b.turn)) AS history_md5, md5(any_value(a.text)) AS reference_md5
    FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND b.turn < a.turn WHERE a.role = 'B' GROUP BY a.item""")
def response_examples(t: Tables) -> DataFrame:
    e = seq.response_examples(t.turns, ["split", "conv_id"])
    hist = F.array_join(F.transform("history", lambda x: F.concat(x["role"], x["text"])), "|")
    return e.select("item", F.md5(hist).alias("history_md5"), F.md5("reference").alias("reference_md5"))


@query("merged_conversations_W8", uses="votes turns", sql="""
    WITH v AS (SELECT conv_id, turn, annotator, CASE WHEN annotator = 1 AND conv_id % 7 = 0 THEN text || '!' ELSE text END AS text
      FROM votes JOIN turns USING (item, conv_id, turn) WHERE NOT (annotator = 3 AND conv_id % 5 = 0))
    SELECT conv_id, count(DISTINCT annotator) AS n_annotators, count(DISTINCT turn) AS n_turns,
      count(DISTINCT annotator) >= 4 AS complete, max(d) > 1 AS mismatch
    FROM v JOIN (SELECT conv_id, turn, count(DISTINCT text) AS d FROM v GROUP BY ALL) USING (conv_id, turn) GROUP BY conv_id""")
def merged_conversations(t: Tables) -> DataFrame:
    changed = F.when((F.col("annotator") == 1) & (F.col("conv_id") % 7 == 0), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    v = t.votes.join(t.turns.select("item", "text"), "item").filter("NOT (annotator = 3 AND conv_id % 5 = 0)")
    return seq.merged_conversations(v.withColumn("text", changed), ["conv_id"], 4, ["role", "text"])


@query("unknown_labels_W8", uses="votes", sql="SELECT label, count(*) AS n FROM votes WHERE label >= 20 GROUP BY label")
def unknown_labels(t: Tables) -> DataFrame:
    return seq.unknown_labels(t.votes, t.membership.filter("label < 20"))


@query("first_by_content_W9", sql="""
    SELECT min(doc_id) AS doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS content FROM documents GROUP BY 2""")
def first_by_content(t: Tables) -> DataFrame:
    key = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
    docs = t.documents.select("doc_id", F.col("doc_id").alias("row_id"), key.alias("content"))
    return seq.first_by_content(docs, "doc_id", ["content"], "row_id").select("doc_id", "content")


# ---- transitions -----------------------------------------------------------------------------------------



def pair_space(t: Tables) -> DataFrame:
    u = uncertain(t).select("item", "reliability", "entropy")
    return t.dist.select("item", "dist").join(u, "item")


def counts(t: Tables) -> DataFrame:
    return tr.soft_counts(tr.pair_ends(t.pairs, pair_space(t)), REGIONS, tr.reliability_weight())


def conds(t: Tables) -> DataFrame:
    return tr.conditionals(counts(t), REGIONS)


@query("soft_counts_T1", uses="full_counts", sql="""
    SELECT pair, source, target, round(n, 6) AS n, round(wn, 6) AS wn FROM full_counts""")
def soft_counts(t: Tables) -> DataFrame:
    return counts(t).select("pair", "source", "target", r6("n"), r6("wn"))


@query("pair_instances_T1", uses="pairs", sql="SELECT pair, count(*) AS instances FROM pairs GROUP BY pair")
def pair_instances(t: Tables) -> DataFrame:
    return tr.instances(t.pairs)


@query("entropy_weighted_T2", uses="pairs regional uncertain grid", sql=f"""
    WITH c AS (SELECT pair, s.region AS source, t.region AS target, sum(s.p * t.p *
        greatest(0.05, (1 - us.entropy / {LN_C}) * (1 - ut.entropy / {LN_C}))) AS n
      FROM pairs JOIN regional s ON s.item = s_item JOIN regional t ON t.item = t_item
      JOIN uncertain us ON us.item = s_item JOIN uncertain ut ON ut.item = t_item WHERE lag = 1 GROUP BY ALL)
    SELECT pair, source, target, round((coalesce(n, 0) + 0.05) / sum(coalesce(n, 0) + 0.05::double) OVER (PARTITION BY pair, source), 6) AS cond
    FROM grid LEFT JOIN c USING (pair, source, target)""")
def entropy_weighted(t: Tables) -> DataFrame:
    ends = tr.pair_ends(t.pairs.filter("lag = 1"), pair_space(t))
    c = tr.soft_counts(ends, REGIONS, tr.entropy_weight(REGIONS))
    return tr.conditionals(c, REGIONS, 0.05).select("pair", "source", "target", r6("cond"))


@query("conditionals_T3", uses="conds", sql="""
    SELECT pair, source, target, round(wn, 6) AS n, round(cond, 6) AS cond, round(source_marginal, 6) AS source_marginal,
      round(target_marginal, 6) AS target_marginal FROM conds""")
def conditionals(t: Tables) -> DataFrame:
    return conds(t).select("pair", "source", "target", r6("n"), r6("cond"), r6("source_marginal"), r6("target_marginal"))


@query("minimum_slice_T3", uses="full_counts", sql=f"""
    SELECT pair, source, target, round((n + 0.1::double) / (sum(n) OVER (PARTITION BY pair, source) + 0.1::double * {REGIONS}), 6) AS cond
    FROM full_counts WHERE pair IN ('A2B', 'B2A')""")
def minimum_slice(t: Tables) -> DataFrame:
    ends = tr.pair_ends(t.pairs.filter("lag = 1"), t.dist.select("item", "dist"))
    c = tr.conditionals(tr.soft_counts(ends, REGIONS), REGIONS, 0.1, "n", ["A2B", "B2A"])
    return c.select("pair", "source", "target", r6("cond"))


@query("association_T4", uses="conds", sql="""
    SELECT pair, source, target, round(joint, 6) AS joint, CASE WHEN lift > 0 THEN round(log2(lift), 6) + 0.0 END AS pmi,
      round(CASE WHEN lift > 0 THEN greatest(0, log2(lift)) ELSE 0 END, 6) AS ppmi, round(lift, 6) AS lift FROM (
      SELECT *, CASE WHEN joint > 0 THEN joint / (source_marginal * target_marginal) ELSE 0 END AS lift FROM (
        SELECT *, wn / sum(wn) OVER (PARTITION BY pair) AS joint FROM conds))""")
def association(t: Tables) -> DataFrame:
    a = tr.association(counts(t), REGIONS)
    return a.select("pair", "source", "target", r6("joint"), r6("pmi"), r6("ppmi"), r6("lift"))


SUMMARY_SQL = """
    s AS (SELECT pair, any_value(i.instances) AS instances, sum(wn) AS total, count(*) FILTER (WHERE wn > 0) AS nonzero_edges,
      count(*) FILTER (WHERE wn > 0) / 36 AS density, avg(abs(cond - cond_plain)) AS mean_delta, max(abs(cond - cond_plain)) AS max_delta
      FROM conds JOIN (SELECT pair, count(*) AS instances FROM pairs GROUP BY pair) i USING (pair) GROUP BY pair)"""


@query("transition_summary_T5", uses="conds pairs", sql=f"""
    WITH {SUMMARY_SQL} SELECT pair, instances, round(total, 6) AS total, nonzero_edges, round(density, 6) AS density,
      round(mean_delta, 6) AS mean_delta, round(max_delta, 6) AS max_delta FROM s""")
def transition_summary(t: Tables) -> DataFrame:
    s = tr.summary(counts(t), t.pairs, REGIONS)
    return s.select("pair", "instances", r6("total"), "nonzero_edges", r6("density"), r6("mean_delta"), r6("max_delta"))


CONCENTRATION_SQL = f"""
    k AS (SELECT pair, source, -sum(cond * ln(cond)) AS entropy, -sum(cond * ln(cond)) / {LN_C} AS norm_entropy,
      arg_min(target, (-round(cond, 12), target)) AS top_target, max(cond) AS top_p FROM conds GROUP BY pair, source)"""


@query("source_concentration_T6", uses="conds", sql=f"""
    WITH {CONCENTRATION_SQL} SELECT pair, source, round(entropy, 6) AS entropy, round(norm_entropy, 6) AS norm_entropy, top_target,
      round(top_p, 6) AS top_p FROM k""")
def source_concentration(t: Tables) -> DataFrame:
    c = tr.source_concentration(conds(t), REGIONS)
    return c.select("pair", "source", r6("entropy"), r6("norm_entropy"), "top_target", r6("top_p"))


@query("graph_summary_T7", uses="conds", sql=f"""
    WITH {CONCENTRATION_SQL} SELECT pair, any_value(e.nonzero_edges) AS nonzero_edges, round(any_value(e.nonzero_edges) / 36, 6) AS density,
      round(avg(entropy), 6) AS mean_entropy, round(avg(norm_entropy), 6) AS mean_norm_entropy, round(avg(top_p), 6) AS mean_top_p,
      round(max(top_p), 6) AS max_top_p
    FROM k JOIN (SELECT pair, count(*) FILTER (WHERE wn > 0) AS nonzero_edges FROM conds GROUP BY pair) e USING (pair) GROUP BY pair""")
def graph_summary(t: Tables) -> DataFrame:
    g = tr.graph_summary(conds(t), REGIONS)
    return g.select("pair", "nonzero_edges", r6("density"), r6("mean_entropy"), r6("mean_norm_entropy"), r6("mean_top_p"), r6("max_top_p"))


@query("strongest_T8", uses="conds", sql="""
    SELECT pair, source, target, round(cond, 6) AS cond FROM conds ORDER BY round(cond, 9) DESC, pair, source, target LIMIT 8""")
def strongest(t: Tables) -> DataFrame:
    return tr.strongest(conds(t), "cond", 8).select("pair", "source", "target", r6("cond"))


@query("strongest_pmi_T8", uses="conds", sql="""
    SELECT pair, source, target, round(pmi, 6) AS pmi FROM (
      SELECT *, log2(wn / sum(wn) OVER (PARTITION BY pair) / (source_marginal * target_marginal)) AS pmi FROM conds WHERE wn > 0)
    ORDER BY round(pmi, 9) DESC, pair, source, target LIMIT 8""")
def strongest_pmi(t: Tables) -> DataFrame:
    return tr.strongest(tr.association(counts(t), REGIONS), "pmi", 8).select("pair", "source", "target", r6("pmi"))


@query("outgoing_winners_T8", uses="conds", sql="""
    SELECT pair, source, target, round(cond, 6) AS cond FROM (SELECT *, row_number() OVER (PARTITION BY pair, source
      ORDER BY round(cond, 9) DESC, target) AS r FROM conds) WHERE r = 1""")
def outgoing_winners(t: Tables) -> DataFrame:
    return tr.outgoing_winners(conds(t)).select("pair", "source", "target", r6("cond"))


@query("common_targets_T8", uses="conds", sql="""
    SELECT pair, target, round(any_value(target_marginal), 6) AS target_marginal FROM conds GROUP BY pair, target
    ORDER BY round(any_value(target_marginal), 9) DESC, pair, target LIMIT 8""")
def common_targets(t: Tables) -> DataFrame:
    return tr.common_targets(conds(t), 8).select("pair", "target", r6("target_marginal"))


@query("metric_mean_T9", uses="conds", sql="""
    SELECT round(avg(cond), 6) AS mean_value, count(*) AS n FROM conds WHERE pair = 'A2B' AND source = 2 AND target < 4""")
def metric_mean(t: Tables) -> DataFrame:
    stored = conds(t).filter("target < 4")
    return tr.metric_mean(stored, "cond", {"pair": "A2B", "source": 2}).select(r6("mean_value"), "n")


@query("stored_matrix_stats_T9", uses="full_counts", sql="""
    SELECT round(sum(nz) / sum(cells), 6) AS density, round(avg(h), 6) AS mean_row_entropy FROM (
      SELECT source, -sum(CASE WHEN wn > 0 THEN p * ln(p) ELSE 0 END) AS h, count(*) FILTER (WHERE wn > 0) AS nz, count(*) AS cells FROM (
        SELECT *, wn / sum(wn) OVER (PARTITION BY source) AS p FROM full_counts WHERE pair = 'A2B') GROUP BY source)""")
def stored_matrix_stats(t: Tables) -> DataFrame:
    wide = counts(t).filter("pair = 'A2B'").groupBy("source").pivot("target", list(range(REGIONS))).agg(F.first("wn")).fillna(0.0)
    s = tr.stored_matrix_stats(wide, "source", [str(i) for i in range(REGIONS)])
    return s.select(r6("density"), r6("mean_row_entropy"))


def prior_rows(t: Tables) -> DataFrame:
    ends = tr.pair_ends(t.pairs.filter("lag = 1"), t.dist.select("item", "dist"))
    return tr.graph_prior(ends, conds(t), REGIONS)


@query("graph_prior_T10", uses="pairs regional conds", sql="""
    SELECT s_item, target, round(x / sum(x) OVER (PARTITION BY s_item), 6) AS prior FROM (
      SELECT s_item, c.target, sum(r.p * c.cond) AS x FROM pairs JOIN regional r ON r.item = s_item
      JOIN conds c ON c.pair = pairs.pair AND c.source = r.region WHERE lag = 1 GROUP BY ALL)""")
def graph_prior(t: Tables) -> DataFrame:
    p = prior_rows(t).select("s_item", F.posexplode("prior").alias("target", "prior"))
    return p.select("s_item", F.col("target").cast("long").alias("target"), r6("prior"))


@query("repaired_graph_T11", uses="conds", sql="""
    SELECT pair, source, target, round(CASE WHEN s > 0 THEN v / s ELSE 1.0::double / 6 END, 6) AS cond FROM (
      SELECT *, sum(v) OVER (PARTITION BY source) AS s FROM (
        SELECT pair, source, target, CASE WHEN source = 1 OR target = 4 THEN 0 ELSE cond END AS v FROM conds WHERE pair = 'B2A'))""")
def repaired_graph(t: Tables) -> DataFrame:
    damaged = conds(t).filter("source <> 1 AND target <> 4")
    return tr.repaired_graph(damaged, "B2A", REGIONS).select("pair", "source", "target", r6("cond"))


@query("qualitative_T12", uses="conds pairs", sql=f"""
    WITH {SUMMARY_SQL} SELECT pair, CASE WHEN density >= 0.67 THEN 'dense' WHEN density <= 0.33 THEN 'sparse' ELSE 'moderately dense' END AS density_word,
      CASE WHEN max_delta >= 0.05 OR mean_delta >= 0.01 THEN 'noticeable' ELSE 'small' END AS reliability_effect FROM s""")
def qualitative(t: Tables) -> DataFrame:
    return tr.qualitative(tr.summary(counts(t), t.pairs, REGIONS))


# ---- checks ----------------------------------------------------------------------------------------------

@query("leaked_tokens_Q3", sql="""
    SELECT doc_id, token FROM documents CROSS JOIN (SELECT unnest(['license', 'http', 'password']) AS token)
    WHERE contains(lower(text), token)""")
def leaked_tokens(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "text")
    return Q.leaked_tokens(docs, "doc_id", ["license", "http", "password"])


@query("export_errors_Q4", uses="votes", sql="""
    WITH a AS (SELECT annotator AS annotator_id, item AS sample_id, label, confidence + (turn % 4 = 3)::int AS confidence FROM votes
        WHERE NOT (annotator = 2 AND conv_id % 9 = 0)),
    s AS (SELECT DISTINCT item AS sample_id FROM votes WHERE split <> 'test'),
    n AS (SELECT count(*) AS want FROM s)
    SELECT annotator_id, sample_id, 'unknown_sample' AS rule FROM a WHERE sample_id NOT IN (SELECT sample_id FROM s)
    UNION ALL SELECT annotator_id, sample_id, 'unknown_label' FROM a WHERE label >= 22
    UNION ALL SELECT annotator_id, sample_id, 'confidence_out_of_range' FROM a WHERE confidence > 5
    UNION ALL SELECT annotator_id, NULL, 'incomplete_samples' FROM (SELECT annotator_id, count(DISTINCT sample_id) AS got FROM a
      WHERE sample_id IN (SELECT sample_id FROM s) GROUP BY 1) CROSS JOIN n WHERE got <> want""")
def export_errors(t: Tables) -> DataFrame:
    a = t.votes.filter("NOT (annotator = 2 AND conv_id % 9 = 0)").select(
        F.col("annotator").alias("annotator_id"), F.col("item").alias("sample_id"), "label",
        (F.col("confidence") + (F.col("turn") % 4 == 3).cast("int")).alias("confidence"),
    )
    samples = t.turns.filter("split <> 'test'").select(F.col("item").alias("sample_id"))
    return Q.export_errors(a, samples, t.membership.filter("label < 22")).select("annotator_id", "sample_id", "rule")


@query("response_errors_Q5", uses="responses", sql="""
    SELECT a.example AS item_id, CASE WHEN trim(a.response) = '' OR trim(b.response) = '' THEN 'empty_response'
        ELSE 'identical_responses' END AS rule
    FROM responses a JOIN responses b USING (example) WHERE a.system = 'trim' AND b.system = 'polite'
      AND (trim(CASE WHEN length(a.response) < 300 THEN '' ELSE a.response END) = '' OR trim(b.response) = '' OR trim(a.response) = trim(b.response))
    """.replace("trim(a.response) = '' OR trim(b.response) = '' THEN", "length(a.response) < 300 OR trim(b.response) = '' THEN"))
def response_errors(t: Tables) -> DataFrame:
    a = t.responses.filter("system = 'trim'").select(
        F.col("example").alias("item_id"), F.when(F.length("response") < 300, "").otherwise(F.col("response")).alias("response_a"))
    b = t.responses.filter("system = 'polite'").select(F.col("example").alias("item_id"), F.col("response").alias("response_b"))
    return Q.response_errors(a.join(b, "item_id"))


@query("package_errors_Q6", uses="turns", sql="""
    WITH p AS (SELECT 'p' || conv_id % 61 AS package_id, conv_id, turn, CASE WHEN turn = 5 THEN '' ELSE text END AS text,
      CASE WHEN turn % 3 = 2 THEN NULL ELSE turn END AS label FROM turns)
    SELECT package_id, 'missing_text' AS rule FROM p WHERE trim(text) = ''
    UNION ALL SELECT package_id, 'missing_label' FROM p WHERE label IS NULL
    UNION ALL SELECT package_id, 'too_short' FROM p GROUP BY 1 HAVING count(DISTINCT turn) < 2
    UNION ALL SELECT package_id, 'duplicate_turn' FROM p GROUP BY package_id, turn HAVING count(*) > 1""")
def package_errors(t: Tables) -> DataFrame:
    p = t.turns.select(
        F.concat(F.lit("p"), F.col("conv_id") % 61).alias("package_id"), "conv_id", "turn",
        F.when(F.col("turn") == 5, "").otherwise(F.col("text")).alias("text"),
        F.when(F.col("turn") % 3 != 2, F.col("turn")).alias("label"),
    )
    return Q.package_errors(p).select("package_id", "rule")


@query("equal_n_Q7", uses="responses", sql="""
    SELECT count(*) AS systems, count(DISTINCT n) AS distinct_n, min(n) AS min_n, max(n) AS max_n, count(DISTINCT n) <= 1 AS ok
    FROM (SELECT system, count(*) AS n FROM responses WHERE NOT (system = 'trim' AND turn = 1) GROUP BY system)""")
def equal_n(t: Tables) -> DataFrame:
    return Q.equal_n(t.responses.filter("NOT (system = 'trim' AND turn = 1)"))


@query("alignment_errors_Q8", uses="turns", sql="""
    SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN turn % 5 = 0 THEN 'a' END, CASE WHEN turn % 3 = 1 THEN 'b' END,
      CASE WHEN role = 'B' AND turn > 4 THEN 'c' END], lambda x: x IS NOT NULL), ',') AS absent_in
    FROM turns WHERE (turn % 5 = 0 OR turn % 3 = 1 OR (role = 'B' AND turn > 4))
      AND NOT (turn % 5 = 0 AND turn % 3 = 1 AND role = 'B' AND turn > 4)""")
def alignment_errors(t: Tables) -> DataFrame:
    x = t.turns
    frames = {"a": x.filter("turn % 5 <> 0"), "b": x.filter("turn % 3 <> 1"), "c": x.filter("NOT (role = 'B' AND turn > 4)")}
    return Q.alignment_errors(frames, ["conv_id", "turn"])


# ---- label aliases ---------------------------------------------------------------------------------------

@query("resolve_labels_X16", uses="votes membership", sql="""
    WITH l AS (SELECT label, chr((128512 + label)::int) || CASE label % 4 WHEN 1 THEN chr(65039) WHEN 2 THEN chr(127997) WHEN 3 THEN '?' ELSE '' END AS name, chr((128512 + label)::int) AS base
      FROM (SELECT DISTINCT label FROM votes))
    SELECT l.name AS label, m.region, round(m.m, 6) AS m, CASE WHEN l.label % 4 = 0 THEN 'exact' ELSE 'unicode_alias' END AS source, CASE WHEN l.label % 4 > 0 THEN base END AS alias
    FROM l JOIN membership m USING (label) WHERE l.label % 4 < 3
    UNION ALL SELECT name, region, round(1.0::double / 6, 6), 'unobserved_uniform', NULL FROM l CROSS JOIN (SELECT unnest(range(0, 6)) AS region) WHERE label % 4 = 3""")
def resolve_labels(t: Tables) -> DataFrame:
    faces = F.array(*[F.lit(chr(0x1F600 + i)) for i in range(LABELS)])
    base = F.element_at(faces, (F.col("label") + 1).cast("int"))
    k = F.col("label") % 4
    name = F.concat(base, F.when(k == 1, "\ufe0f").when(k == 2, "\U0001F3FD").when(k == 3, "?").otherwise(""))
    m = t.membership.withColumn("label", base)
    used = t.votes.select("label").distinct().select(name.alias("label"))
    r = mem.resolve_labels(used, m)
    return r.select("label", "region", r6("m"), "source", "alias")
