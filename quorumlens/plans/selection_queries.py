"""Queries for selection and controls (K), sampling (A), judgements (J), result tables (B) and their checks (Q5, Q9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dist as D
from ..functions.keys import hash60
from ..functions.lineage import checkpointed
from ..operators import judge as J
from ..operators import membership as mem
from ..operators import metrics as M
from ..operators import quality as Q
from ..operators import sample as A
from ..operators import select as K
from ..operators import softlabel as sl
from ..operators import tables as B
from ..operators import textmetrics as TM
from .fixtures import CTES, ITEM, REGIONS, Tables, r6
from .model_queries import gated
from .registry import query
from .space_queries import uncertain

HASH = "('0x'||substr(md5({}),1,15))::bigint"
SYSTEMS = ["echo", "trim", "polite"]
CTES.update({
    "cands_long": ("responses preds", f"""
        SELECT example, system, idx, split, region, gold, control, raw / sum(raw) OVER (PARTITION BY example, idx) AS pred FROM (
          SELECT r.example, r.system, CASE r.system WHEN 'echo' THEN 0 WHEN 'trim' THEN 1 ELSE 2 END AS idx, p.split, p.region, p.gold, p.pred AS control,
            0.05::double + p.gold * 0.5::double + ({HASH.format("concat_ws('|', 'k', r.example, r.system, p.region)")} % 100)::double / 150 AS raw
          FROM responses r JOIN preds p ON p.item = r.example)"""),
    "cands": ("cands_long", """
        SELECT example, system, idx, any_value(split) AS split, -sum(gold * ln(pred)) AS gold_ce, -sum(control * ln(pred)) AS control_ce,
          sum(CASE WHEN gold > 0 THEN gold * ln(gold / pred) ELSE 0 END) AS gold_kl, sum(control * ln(control / pred)) AS control_kl,
          arg_min(region, (-pred, region)) AS yhat, arg_min(region, (-gold, region)) AS y FROM cands_long GROUP BY example, system, idx"""),
    "picked": ("cands", """
        SELECT c.*, selection, candidates FROM cands c JOIN (
          SELECT example, count(*) AS candidates, [arg_min(idx, idx), arg_min(idx, (round(control_ce, 12), idx)), arg_min(idx, (round(gold_ce, 12), idx))] AS best
          FROM cands GROUP BY example) USING (example) JOIN (SELECT unnest(['first', 'best_control', 'best_gold']) AS selection, unnest([1, 2, 3]) AS k) ON best[k] = idx"""),
    "verdicts": ("votes", f"""
        SELECT item, split, conv_id AS package_id, turn, role, annotator, CASE WHEN v < 4 THEN 'reasonable' WHEN v = 4 THEN 'questionable_but_acceptable'
          ELSE 'clearly_unreasonable' END AS label FROM (SELECT *, {HASH.format("concat_ws('|', 'j', item, annotator)")} % 6 AS v FROM votes WHERE annotator < 3)"""),
    "outcomes": ("verdicts", """
        SELECT item, any_value(split) AS split, any_value(package_id) AS package_id, any_value(role) AS role, count(DISTINCT annotator) AS annotators, a AS reasonable, b AS questionable, c AS unreasonable,
          (a > 0)::int + (b > 0)::int + (c > 0)::int > 1 AS disagreement,
          CASE WHEN c >= 2 THEN 'invalid' WHEN b >= 2 OR (a = 1 AND b = 1 AND c = 1) THEN 'ambiguous' ELSE 'valid' END AS outcome FROM (
          SELECT *, count(*) FILTER (WHERE label = 'reasonable') OVER w AS a, count(*) FILTER (WHERE label = 'questionable_but_acceptable') OVER w AS b,
            count(*) FILTER (WHERE label = 'clearly_unreasonable') OVER w AS c FROM verdicts WINDOW w AS (PARTITION BY item)) GROUP BY item, a, b, c"""),
})


def candidates(t: Tables) -> DataFrame:
    r = t.responses.select("system", "example", "response").join(t.preds.select(F.col("item").alias("example"), "split", "gold", F.col("pred").alias("control")), "example")
    noise = lambda j: (hash60(F.lit("k"), F.col("example"), F.col("system"), F.lit(j)) % 100).cast("double") / 150.0
    raw = F.array(*[F.lit(0.05) + F.element_at("gold", j + 1) * 0.5 + noise(j) for j in range(REGIONS)])
    idx = F.when(F.col("system") == "echo", 0).when(F.col("system") == "trim", 1).otherwise(2)
    return r.withColumns({"idx": idx, "_raw": raw}).withColumn("pred", F.transform("_raw", lambda x: x / D.vsum(F.col("_raw")))).drop("_raw")


def scored_candidates(t: Tables) -> DataFrame:
    return K.candidate_scores(candidates(t), "pred", "gold", "control")


@query("candidate_scores_K1", uses="cands", sql="""
    SELECT example, idx, round(gold_ce, 6) AS gold_ce, round(gold_kl, 6) + 0.0 AS gold_kl, round(control_ce, 6) AS control_ce, round(control_kl, 6) + 0.0 AS control_kl FROM cands""")
def candidate_scores(t: Tables) -> DataFrame:
    return scored_candidates(t).select("example", "idx", r6("gold_ce"), r6("gold_kl"), r6("control_ce"), r6("control_kl"))


def picked(t: Tables) -> DataFrame:
    return K.best_of_n(scored_candidates(t), ["example", "split"], "idx", ["pred", "gold", "control", "gold_ce", "control_ce"])


@query("best_of_n_K2", uses="picked", sql="""
    SELECT example, candidates, selection, idx AS selected_index, round(gold_ce, 6) AS gold_ce, round(control_ce, 6) AS control_ce FROM picked""")
def best_of_n(t: Tables) -> DataFrame:
    return picked(t).select("example", "candidates", "selection", "selected_index", r6("gold_ce"), r6("control_ce"))


@query("pool_metrics_K3", uses="cands", sql="""
    SELECT split, count(*) AS examples, round(avg(n), 6) AS mean_candidates, round(avg(fc), 6) AS first_control_ce, round(avg(bc), 6) AS best_control_ce,
      round(avg(fc) - avg(bc), 6) + 0.0 AS control_gain, round(avg(fg) - avg(bg), 6) + 0.0 AS gold_gain FROM (
      SELECT split, example, count(*) AS n, arg_min(control_ce, idx) AS fc, min(control_ce) AS bc, arg_min(gold_ce, idx) AS fg, min(gold_ce) AS bg FROM cands GROUP BY ALL) GROUP BY split""")
def pool_metrics(t: Tables) -> DataFrame:
    p = K.pool_metrics(scored_candidates(t), ["split"], "example", "idx")
    return p.select("split", "examples", r6("mean_candidates"), r6("first_control_ce"), r6("best_control_ce"), r6("control_gain"), r6("gold_gain"))


@query("selection_metrics_K4", uses="picked", sql="""
    SELECT split, selection, count(*) AS n, round(avg(gold_ce), 6) AS ce, round(avg((y = yhat)::int), 6) AS accuracy, round(avg(idx), 6) AS mean_index,
      count(*) FILTER (WHERE yhat = 2) AS top_2 FROM picked GROUP BY split, selection""")
def selection_metrics(t: Tables) -> DataFrame:
    m = K.selection_metrics(picked(t), ["split", "selection"], REGIONS)
    return m.select("split", "selection", "n", r6("ce"), r6("accuracy"), r6("mean_index"), F.element_at("histogram", 3).alias("top_2"))


@query("control_table_K5", uses="turns preds", sql=f"""
    WITH o AS (SELECT item, row_number() OVER (ORDER BY {HASH.format("'0|' || item")}, item) - 1 AS pos FROM turns),
    n AS (SELECT count(*) AS n FROM turns), p AS (SELECT a.item, b.item AS partner FROM o a CROSS JOIN n JOIN o b ON b.pos = (a.pos + 1) % n),
    g AS (SELECT item, max(gold) FILTER (region = 1) AS g1, max(pred) FILTER (region = 1) AS p1 FROM preds GROUP BY item)
    SELECT p.item, partner AS partner_item, c AS control, round(CASE c WHEN 'gold' THEN g.g1 WHEN 'predicted' THEN g.p1 WHEN 'shuffled' THEN h.g1 END, 6) AS d1
    FROM p JOIN g USING (item) JOIN g h ON h.item = partner CROSS JOIN (SELECT unnest(['gold', 'predicted', 'zero', 'shuffled']) AS c)""")
def control_table(t: Tables) -> DataFrame:
    gold, predicted = t.preds.select("item", F.col("gold").alias("d")), t.preds.select("item", F.col("pred").alias("d"))
    c = K.control_table(gold, predicted, ["item"], "d")
    return c.select("item", "partner_item", "control", r6(F.element_at("dist", 2), "d1"))


@query("row_subset_K6", uses="turns", sql=f"""
    SELECT 'first' AS strategy, item FROM (SELECT item FROM turns ORDER BY item LIMIT 40)
    UNION ALL SELECT 'seeded', item FROM (SELECT item FROM turns ORDER BY {HASH.format("'7|' || item")}, item LIMIT 40)""")
def row_subset(t: Tables) -> DataFrame:
    a = K.row_subset(t.turns.select("item"), 40, ["item"]).select(F.lit("first").alias("strategy"), "item")
    return a.unionByName(K.row_subset(t.turns.select("item"), 40, ["item"], "seeded", 7).select(F.lit("seeded").alias("strategy"), "item"))


@query("context_filter_K7", uses="dist", sql="""
    SELECT item, top, round(p1, 6) AS top_p, round(p1 - p2, 6) AS margin FROM (
      SELECT item, any_value(role) AS role, arg_min(region, (-p, region)) AS top, list_sort(list(p), 'DESC')[1] AS p1, list_sort(list(p), 'DESC')[2] AS p2 FROM dist GROUP BY item)
    WHERE p1 >= 0.4 AND round(p1 - p2, 9) >= 0.1 AND top IN (0, 2, 3) AND role = 'A'""")
def context_filter(t: Tables) -> DataFrame:
    rows = t.dist.withColumn("transition", F.concat("role", F.lit("->"), F.when(F.col("role") == "A", "B").otherwise("A")))
    c = K.context_filter(rows, "dist", [0, 2, 3], 0.4, 0.1 - 1e-9, ["A->B"])
    return c.select("item", "top", r6("top_p"), r6("margin"))


def controlled(t: Tables) -> DataFrame:
    return candidates(t).withColumn("control_region", F.col("idx") * 2)


@query("control_summary_K8", uses="cands_long cands responses", sql="""
    SELECT idx * 2 AS control_region, count(*) AS n, round(avg((yhat = idx * 2)::int), 6) AS hit_rate, round(avg(p), 6) AS mean_p, round(avg(-ln(p)), 6) AS control_ce,
      round(avg((yhat = y)::int), 6) AS gold_accuracy, round(avg(w), 6) AS mean_words FROM cands c
    JOIN (SELECT example, idx, max(pred) FILTER (region = idx * 2) AS p FROM cands_long GROUP BY ALL) USING (example, idx)
    JOIN (SELECT example, system, len(list_filter(string_split_regex(response, '\\s+'), lambda x: x <> '')) AS w FROM responses) r ON r.example = c.example AND r.system = c.system
    GROUP BY idx""")
def control_summary(t: Tables) -> DataFrame:
    s = K.control_summary(controlled(t), [], REGIONS)
    return s.select("control_region", "n", r6("hit_rate"), r6("mean_p"), r6("control_ce"), r6("gold_accuracy"), r6("mean_words"))


STRIPPED = """list_distinct(list_filter(list_transform(string_split_regex(response, '\\s+'), lambda w: lower(trim(w, '.,!?;:''"()[]{} '))), lambda w: w <> ''))"""


@query("control_contrast_K8", uses="cands_long cands responses", sql=f"""
    WITH w AS (SELECT example, system, {STRIPPED} AS s FROM responses),
    x AS (SELECT c.example, max(yhat) FILTER (idx = 0) AS t0, max(yhat) FILTER (idx = 1) AS t2, max(yhat) FILTER (idx = 2) AS t4 FROM cands c GROUP BY example),
    p AS (SELECT example, max(pred) FILTER (idx = 0) AS p0, max(pred) FILTER (idx = 1) AS p2, max(pred) FILTER (idx = 2) AS p4 FROM cands_long WHERE region = 2 GROUP BY example),
    j AS (SELECT a.example, avg(CASE WHEN len(list_distinct(a.s || b.s)) > 0 THEN len(list_intersect(a.s, b.s)) / len(list_distinct(a.s || b.s)) ELSE 1 END) AS jac
      FROM w a JOIN w b ON a.example = b.example AND a.system < b.system GROUP BY a.example)
    SELECT example, len(list_distinct([t0, t2, t4])) AS distinct_tops, len(list_distinct([t0, t2, t4])) > 1 AS top_changes, round(jac, 6) AS mean_jaccard,
      t2 = 2 AS focus_hit, round(p2 - greatest(p0, p4), 6) + 0.0 AS focus_lift FROM x JOIN p USING (example) JOIN j USING (example)""")
def control_contrast(t: Tables) -> DataFrame:
    c = K.control_contrast(controlled(t), ["example"], [0, 2, 4], 2)
    return c.select("example", "distinct_tops", "top_changes", r6("mean_jaccard"), "focus_hit", r6("focus_lift"))


@query("targeted_K9", uses="gated", sql="""
    WITH f AS (SELECT item, any_value(role) AS transition, arg_min(region, (-gold, region)) = 3 AS gold_top, any_value(gate) >= 0.5 AS gate_active,
        arg_min(region, (-gated, region)) = 3 AS gated_top, arg_min(region, (-ungated, region)) = 3 AS ungated_top FROM gated GROUP BY item),
    s AS (SELECT 'all' AS stage, * FROM f UNION ALL SELECT 'union', * FROM f WHERE gold_top OR gate_active UNION ALL SELECT 'intersection', * FROM f WHERE gold_top AND gate_active)
    SELECT stage, transition, count(*) AS n, sum(gold_top::int)::bigint AS n_gold_top, sum(gate_active::int)::bigint AS n_gate_active,
      sum(gated_top::int)::bigint AS n_gated_top, sum(ungated_top::int)::bigint AS n_ungated_top FROM s GROUP BY stage, transition""")
def targeted(t: Tables) -> DataFrame:
    f = K.target_flags(gated(t), 3).withColumn("transition", F.col("role"))
    groups = ["gold_top", "gate_active"]
    return Q.union_all([K.reason_counts(f, "all"), K.reason_counts(K.targeted(f, groups), "union"), K.reason_counts(K.targeted(f, groups, "intersection"), "intersection")])


def outputs(t: Tables) -> DataFrame:
    """Artifacts that know their example by id, by id prefix, by a turn off by one, by content, or not at all."""
    k = hash60(F.lit("o"), F.col("system"), F.col("example")) % 5
    content = F.sha2(F.concat("context", F.lit("#"), "reference"), 256)
    return t.responses.withColumn("k", k).select(
        F.concat("system", F.lit("|"), "example").alias("row_id"), "system", "response",
        F.when(F.col("k") == 0, F.col("example")).when(F.col("k") == 1, F.concat("example", F.lit("_direct_"), "system")).alias("example_ref"),
        F.when(F.col("k") == 2, F.col("conv_id")).alias("conv_id"), F.when(F.col("k") == 2, F.col("turn") - 1).alias("turn"),
        F.when(F.col("k") == 3, content).alias("content"))


def aligned(t: Tables) -> DataFrame:
    canonical = t.examples.select("example", "conv_id", "turn", F.sha2(F.concat("context", F.lit("#"), "reference"), 256).alias("content"), F.col("example").alias("ord"))
    return K.align(outputs(t), K.canonical_index(canonical))


CTES["aligned"] = ("responses examples", f"""
    SELECT r.system || '|' || r.example AS row_id, r.system, r.response, CASE WHEN k < 2 THEN r.example WHEN k = 2 THEN coalesce(e.example, f.example, g.example) WHEN k = 3 THEN c.example END AS example,
      CASE k WHEN 0 THEN 'id' WHEN 1 THEN 'id_prefix' WHEN 2 THEN CASE WHEN coalesce(e.example, f.example, g.example) IS NULL THEN 'unmatched' ELSE 'turn' END WHEN 3 THEN 'content' ELSE 'unmatched' END AS method
    FROM (SELECT *, {HASH.format("concat_ws('|', 'o', system, example)")} % 5 AS k FROM responses) r
    LEFT JOIN examples e ON e.conv_id = r.conv_id AND e.turn = r.turn - 1 LEFT JOIN examples f ON f.conv_id = r.conv_id AND f.turn = r.turn
    LEFT JOIN examples g ON g.conv_id = r.conv_id AND g.turn = r.turn - 2
    LEFT JOIN (SELECT context, reference, max(example) AS example FROM examples GROUP BY ALL) c ON c.context = r.context AND c.reference = r.reference""")


@query("align_K10", uses="aligned", sql="SELECT row_id, example, method FROM aligned")
def align(t: Tables) -> DataFrame:
    return aligned(t).select("row_id", "example", "method")


@query("coverage_K11", uses="responses examples", sql="""
    WITH o AS (SELECT system, example FROM responses WHERE NOT (system = 'trim' AND turn = 3) UNION ALL SELECT system, example || 'x' FROM responses WHERE system = 'echo' AND turn = 1
      UNION ALL SELECT system, example FROM responses WHERE system = 'polite' AND turn = 1)
    SELECT system, expected, count(*) AS generated, count(DISTINCT o.example) FILTER (WHERE e.example IS NOT NULL) AS matched, count(DISTINCT o.example) FILTER (WHERE e.example IS NULL) AS extra,
      count(*) - count(DISTINCT o.example) AS duplicates, expected - count(DISTINCT o.example) FILTER (WHERE e.example IS NOT NULL) AS missing, false AS ok
    FROM o LEFT JOIN examples e USING (example) CROSS JOIN (SELECT count(*) AS expected FROM examples) GROUP BY system, expected""")
def coverage(t: Tables) -> DataFrame:
    r = t.responses.select("system", "example", "turn")
    o = r.filter("NOT (system = 'trim' AND turn = 3)").unionByName(r.filter("system = 'echo' AND turn = 1").withColumn("example", F.concat("example", F.lit("x")))).unionByName(
        r.filter("system = 'polite' AND turn = 1"))
    return K.coverage(o, t.examples)


@query("common_examples_K12", uses="responses", sql="""
    SELECT a.example, length(a.response) AS echo_chars, length(b.response) AS trim_chars, length(c.response) AS polite_chars FROM responses a JOIN responses b USING (example) JOIN responses c USING (example)
    WHERE a.system = 'echo' AND b.system = 'trim' AND c.system = 'polite' AND b.turn <> 3 AND c.turn <> 5""")
def common_examples(t: Tables) -> DataFrame:
    r = t.responses.withColumn("ord", F.col("turn"))
    frames = {"echo": r.filter("system = 'echo'"), "trim": r.filter("system = 'trim' AND turn <> 3"), "polite": r.filter("system = 'polite' AND turn <> 5")}
    c = K.common_examples(frames, "example", "response", "ord")
    return c.select("example", *[F.length(s).cast("long").alias(s + "_chars") for s in SYSTEMS])


@query("control_variants_K13", uses="gated", sql="""
    SELECT item, c AS control, round(CASE c WHEN 'gold' THEN gold WHEN 'ungated' THEN ungated WHEN 'gated' THEN gated ELSE 1.0 END, 6) AS p3,
      CASE c WHEN 'gold' THEN 'gold' WHEN 'gated' THEN 'gated' WHEN 'forced' THEN 'forced_region' ELSE CASE WHEN gate >= 0.5 THEN 'gated_columns' ELSE 'ungated_table' END END AS source
    FROM gated CROSS JOIN (SELECT unnest(['gold', 'ungated', 'gated', 'forced']) AS c) WHERE region = 3""")
def control_variants(t: Tables) -> DataFrame:
    g = gated(t)
    own = F.when(F.col("gate") >= 0.5, F.col("ungated"))
    v = K.control_variants(g.select("item", F.col("gold").alias("dist")), g.select("item", F.col("gated").alias("dist"), own.alias("ungated_dist")),
                           g.select("item", F.col("ungated").alias("dist")), ["item"], 3, REGIONS)
    return v.select("item", "control", r6(F.element_at("dist", 4), "p3"), "source")


@query("artifact_status_K14", uses="aligned examples", sql="""
    SELECT system, count(*) AS raw_rows, count(DISTINCT example) FILTER (WHERE trim(response) <> '') AS matched, count(*) FILTER (WHERE method = 'id_prefix') AS by_id_prefix,
      count(*) FILTER (WHERE method = 'unmatched') AS by_unmatched, round(count(DISTINCT example) FILTER (WHERE trim(response) <> '') / (SELECT count(*) FROM examples), 6) AS coverage
    FROM aligned GROUP BY system""")
def artifact_status(t: Tables) -> DataFrame:
    s = K.artifact_status(aligned(t), t.examples)
    return s.select("system", "raw_rows", "matched", "by_id_prefix", "by_unmatched", r6("coverage"))


def run_rows(t: Tables) -> DataFrame:
    return picked(t).select(F.col("selection").alias("run"), F.lit("all").alias("group_value"), "split", "example")


@query("run_check_K15", uses="picked", sql="""
    WITH s AS (SELECT run, split, expected FROM (SELECT unnest(['first', 'best_gold', 'other']) AS run) CROSS JOIN (SELECT unnest(['train', 'test']) AS split)
      CROSS JOIN (SELECT count(*) AS expected FROM picked WHERE selection = 'first' AND split = 'train')),
    p AS (SELECT selection AS run, split, count(*) AS n FROM picked GROUP BY ALL)
    SELECT run, split, expected, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'missing' WHEN n <> expected THEN 'wrong_count' ELSE 'ok' END AS state
    FROM s LEFT JOIN p USING (run, split)""")
def run_check(t: Tables) -> DataFrame:
    rows = run_rows(t)
    want = rows.filter("run = 'first' AND split = 'train'").agg(F.count(F.lit(1)).alias("expected"))
    names = F.explode(F.array(*[F.struct(F.lit(r).alias("run"), F.lit(s).alias("split")) for r in ("first", "best_gold", "other") for s in ("train", "test")]))
    spec = want.select("expected", names.alias("n")).select("n.run", F.lit("all").alias("group_value"), "n.split", "expected")
    return K.run_check(rows, spec).select("run", "split", "expected", "n", "state")


# ---- sampling --------------------------------------------------------------------------------------------

CTES["strata"] = ("uncertain turns", """
    SELECT *, CASE ntile(3) OVER (ORDER BY e, item) WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS stratum
    FROM (SELECT item, t.conv_id, t.split, t.turn, t.role, round(entropy, 9) + 0.0 AS e, top_region FROM uncertain JOIN turns t USING (item))""")


def strata(t: Tables) -> DataFrame:
    u = uncertain(t).select("item", (F.round("entropy", 9) + F.lit(0.0)).alias("e"), "top_region")
    rows = t.turns.select("item", "conv_id", "split", "turn", "role").join(u, "item")
    return A.entropy_tertiles(checkpointed(rows), "e", ["item"])


@query("entropy_tertiles_A1", uses="strata", sql="SELECT item, stratum, round(e, 6) AS e FROM strata")
def entropy_tertiles(t: Tables) -> DataFrame:
    return strata(t).select("item", "stratum", r6("e"))


CTES["quotas"] = ("", """
    SELECT seg, n, q + CASE WHEN r <= 50 - sum(q) OVER () THEN 1 ELSE 0 END AS quota FROM (
      SELECT *, row_number() OVER (ORDER BY round(raw - q, 12) DESC, n DESC, seg) AS r FROM (
        SELECT *, floor(raw)::bigint AS q FROM (SELECT c_mktsegment AS seg, count(*) AS n, count(*) * 50 / sum(count(*)) OVER () AS raw FROM customer GROUP BY 1)))""")


def quotas(t: Tables) -> DataFrame:
    counts = t.read("customer").groupBy(F.col("c_mktsegment").alias("seg")).agg(F.count(F.lit(1)).alias("n"))
    return A.largest_remainder(counts, "seg", 50)


@query("largest_remainder_A2", uses="quotas", sql="SELECT seg, n, quota::bigint AS quota FROM quotas")
def largest_remainder(t: Tables) -> DataFrame:
    return quotas(t)


@query("stratified_A3", uses="quotas", sql=f"""
    SELECT c_custkey, c_mktsegment AS seg FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {HASH.format("'5|' || c_custkey")}, c_custkey) AS r FROM customer)
    JOIN quotas ON seg = c_mktsegment WHERE r <= quota""")
def stratified(t: Tables) -> DataFrame:
    c = t.read("customer").select("c_custkey", F.col("c_mktsegment").alias("seg"))
    return A.stratified(c, "seg", ["c_custkey"], quotas(t), 5).select("c_custkey", "seg")


@query("common_ids_A3", sql="""
    SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_linenumber) >= 5""")
def common_ids(t: Tables) -> DataFrame:
    return A.common_ids(t.read("lineitem").withColumnRenamed("l_linenumber", "annotator"), 5, ["l_orderkey"])


@query("annotator_slots_A4", sql=f"""
    SELECT o_orderkey, ['ann', 'bob', 'cyd'][(row_number() OVER (ORDER BY {HASH.format("'2|' || o_orderkey")}, o_orderkey) - 1) % 3 + 1] AS slot FROM orders""")
def annotator_slots(t: Tables) -> DataFrame:
    return A.annotator_slots(t.read("orders").select("o_orderkey"), ["o_orderkey"], ["ann", "bob", "cyd"], 2).select("o_orderkey", "slot")


def diverse(t: Tables, n: int = 8) -> DataFrame:
    return A.diverse_sample(strata(t), "stratum", ["top_region", "role"], "conv_id", ["item"], n, 3)


CTES["diverse"] = ("strata", f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY r2, h, item) AS r3 FROM (
      SELECT *, row_number() OVER (PARTITION BY stratum, top_region ORDER BY r1, h, item) AS r2 FROM (
        SELECT *, row_number() OVER (PARTITION BY stratum, top_region, role ORDER BY h, item) AS r1 FROM (
          SELECT *, {HASH.format("'3|' || item")} AS h FROM strata QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY {HASH.format("'3|' || item")}, item) = 1)))) WHERE r3 <= 8""")


@query("diverse_sample_A5", uses="diverse", sql="SELECT item, stratum, top_region, role FROM diverse")
def diverse_sample(t: Tables) -> DataFrame:
    return diverse(t).select("item", "stratum", "top_region", "role")


@query("round_robin_A6", uses="strata", sql=f"""
    SELECT item, top_region FROM (SELECT *, row_number() OVER (PARTITION BY top_region ORDER BY {HASH.format("'4|' || item")}, item) AS r FROM strata WHERE conv_id % 4 <> 0)
    ORDER BY r, top_region LIMIT 30""")
def round_robin(t: Tables) -> DataFrame:
    s = strata(t)
    return A.round_robin(s, s.filter("conv_id % 4 = 0"), "conv_id", "top_region", ["item"], 30, 4).select("item", "top_region")


COMPARISONS = ["main_vs_echo", "main_vs_trim"]


def assigned(t: Tables) -> DataFrame:
    items = A.pairwise_items(t.examples.select(F.col("example").alias("context_id")), COMPARISONS)
    items = items.withColumn("item_id", F.concat("context_id", F.lit("/"), "comparison"))
    return A.balance_sides(A.assign_raters(items, "context_id", COMPARISONS, 7, 3), ["item_id", "rater"], 9)


@query("pairwise_items_A7", uses="examples", sql="SELECT example AS context_id, c AS comparison FROM examples CROSS JOIN (SELECT unnest(['main_vs_echo', 'main_vs_trim']) AS c)")
def pairwise_items(t: Tables) -> DataFrame:
    return A.pairwise_items(t.examples.select(F.col("example").alias("context_id")), COMPARISONS)


CTES["assigned"] = ("examples", f"""
    SELECT *, context_id || '/' || comparison AS item_id, (c + 1 + j * 3 + s) % 7 AS rater, c % 7 AS held_out FROM (
      SELECT example AS context_id, row_number() OVER (ORDER BY {HASH.format("'contexts|' || example")}, example) - 1 AS c FROM examples)
    CROSS JOIN (SELECT unnest(['main_vs_echo', 'main_vs_trim']) AS comparison, unnest([0, 1]) AS j) CROSS JOIN (SELECT unnest([0, 1, 2]) AS s)""")
CTES["sided"] = ("assigned", f"""
    SELECT *, row_number() OVER (PARTITION BY comparison ORDER BY {HASH.format("concat_ws('|', '9', item_id, rater)")}, item_id, rater) - 1 < floor(count(*) OVER (PARTITION BY comparison) / 2) AS main_on_a FROM assigned""")


@query("assign_raters_A8_A9", uses="sided", sql="SELECT item_id, rater::bigint AS rater, held_out::bigint AS held_out, main_on_a FROM sided")
def assign_raters(t: Tables) -> DataFrame:
    return assigned(t).select("item_id", "rater", "held_out", "main_on_a")


@query("assignment_errors_Q5", uses="sided", sql="""
    SELECT key, rule FROM (SELECT item_id AS key, 'raters_per_item' AS rule FROM sided WHERE context_id NOT LIKE '%|1' OR rater <> 0 GROUP BY item_id HAVING count(DISTINCT rater) <> 3)
    UNION ALL SELECT 'loads', 'load_spread' FROM (SELECT rater, count(*) AS n FROM sided WHERE context_id NOT LIKE '%|1' OR rater <> 0 GROUP BY rater) HAVING max(n) - min(n) > 12""")
def assignment_errors(t: Tables) -> DataFrame:
    damaged = assigned(t).filter("context_id NOT LIKE '%|1' OR rater <> 0").withColumn("position_a", F.lit(True))
    return Q.assignment_errors(damaged, 3, 12).filter("rule <> 'side_imbalance'")


@query("conversation_sample_A10", uses="turns", sql=f"""
    SELECT conv_id, item FROM (SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY {HASH.format("'6|' || item")}, item) = 1)
    ORDER BY {HASH.format("'6|' || conv_id")}, conv_id LIMIT 25""")
def conversation_sample(t: Tables) -> DataFrame:
    return A.conversation_sample(t.turns, "conv_id", ["item"], 25, 6).select("conv_id", "item")


def metadata(t: Tables) -> DataFrame:
    c = t.read("conversations")
    return c.filter("role = 'system' OR turn = 0").select("conv_id", F.length("text").cast("long").alias("chars"), F.col("role").alias("emotion"), (-F.col("turn")).alias("ord"))


@query("packages_A11", uses="turns", sql="""
    SELECT conv_id, n, meta, labels FROM (SELECT conv_id, count(*) AS n, string_agg((turn % 7)::varchar, ',' ORDER BY turn) AS labels FROM turns GROUP BY conv_id HAVING count(*) >= 2)
    LEFT JOIN (SELECT conv_id, arg_min(role, -turn) AS meta FROM conversations WHERE role = 'system' OR turn = 0 GROUP BY conv_id) USING (conv_id) WHERE conv_id % 3 = 0""")
def packages(t: Tables) -> DataFrame:
    turns = t.turns.select("conv_id", "turn", "role", "text", (F.col("turn") % 7).alias("label"))
    sampled = t.turns.filter("conv_id % 3 = 0").select("conv_id").distinct()
    p = A.packages(sampled, turns, metadata(t))
    labels = F.array_join(F.transform("turns", lambda x: x["label"].cast("string")), ",")
    return p.select("conv_id", F.size("turns").cast("long").alias("n"), F.col("meta.emotion").alias("meta"), labels.alias("labels"))


@query("split_blind_A12", uses="sided", sql="SELECT item_id, rater::bigint AS rater, comparison, main_on_a FROM sided")
def split_blind(t: Tables) -> DataFrame:
    public, private = A.split_blind(assigned(t), ["item_id", "rater"], ["comparison"], ["main_on_a"])
    return public.join(private, ["item_id", "rater"])


@query("sampling_summary_A13", uses="strata diverse", sql="""
    SELECT 'candidates' AS metric, stratum AS value, count(*)::double AS number FROM strata GROUP BY stratum
    UNION ALL SELECT 'sampled', stratum, count(*) FROM diverse GROUP BY stratum UNION ALL SELECT 'top_region', top_region::varchar, count(*) FROM diverse GROUP BY top_region
    UNION ALL SELECT 'entropy_min', stratum, round(min(e), 6) FROM diverse GROUP BY stratum UNION ALL SELECT 'entropy_mean', stratum, round(avg(e), 6) FROM diverse GROUP BY stratum
    UNION ALL SELECT 'entropy_max', stratum, round(max(e), 6) FROM diverse GROUP BY stratum UNION ALL SELECT 'entropy_median', stratum, round(median(e), 6) FROM diverse GROUP BY stratum
    UNION ALL SELECT 'duplicate_conversations', 'all', 0""")
def sampling_summary(t: Tables) -> DataFrame:
    return A.sampling_summary(strata(t), diverse(t), "e", ["top_region"]).select("metric", "value", r6("number"))


@query("fixed_quota_A14", uses="sided", sql=f"""
    SELECT item_id, rater::bigint AS rater FROM (SELECT *, row_number() OVER (PARTITION BY comparison ORDER BY {HASH.format("concat_ws('|', '8', item_id, rater)")}, item_id, rater) AS r FROM sided)
    WHERE r <= CASE comparison WHEN 'main_vs_echo' THEN 7 ELSE 6 END""")
def fixed_quota(t: Tables) -> DataFrame:
    a = assigned(t)
    q = a.groupBy("comparison").agg(F.when(F.first("comparison") == "main_vs_echo", 7).otherwise(6).alias("quota"))
    return A.stratified(a, "comparison", ["item_id", "rater"], q, 8).select("item_id", "rater")


@query("blind_options_A15", uses="responses", sql=f"""
    SELECT example, system, chr((64 + row_number() OVER (PARTITION BY example ORDER BY {HASH.format("concat_ws('|', '1', example, system)")}, system))::int) AS option FROM responses""")
def blind_options(t: Tables) -> DataFrame:
    return A.blind_options(t.responses.select("example", "system"), "example", "system", 1)


@query("sampled_set_errors_Q9", uses="diverse", sql="""
    SELECT item AS key, 'missing_in_public' AS rule FROM diverse WHERE turn = 1 UNION ALL SELECT item, 'turn' FROM diverse WHERE turn < 1
    UNION ALL SELECT count(*)::varchar, 'size' FROM diverse HAVING count(*) <> 25""")
def sampled_set_errors(t: Tables) -> DataFrame:
    s = diverse(t).withColumnRenamed("item", "sample_id")
    again = diverse(Tables(t.spark, t.sf_dir)).withColumnRenamed("item", "sample_id")
    return Q.sampled_set_errors(s, s.filter("turn <> 1"), again, 25, 3, 24, t.membership)


# ---- judgements --------------------------------------------------------------------------------------------

def verdicts(t: Tables) -> DataFrame:
    v = hash60(F.lit("j"), F.col("item"), F.col("annotator")) % 6
    label = F.when(v < 4, J.REASONABLE).when(v == 4, J.QUESTIONABLE).otherwise(J.UNREASONABLE)
    return t.votes.filter("annotator < 3").select("item", "split", F.col("conv_id").alias("package_id"), "turn", "role", "annotator", label.alias("label"))


def outcomes(t: Tables) -> DataFrame:
    return J.majority(verdicts(t), ["item", "split", "package_id", "role"])


@query("majority_J1", uses="outcomes", sql="SELECT item, annotators, reasonable, questionable, unreasonable, disagreement, outcome FROM outcomes")
def majority(t: Tables) -> DataFrame:
    return outcomes(t).select("item", "annotators", "reasonable", "questionable", "unreasonable", "disagreement", "outcome")


@query("proportions_J2", uses="outcomes", sql="""
    WITH s AS (SELECT 'overall' AS grp, 'all' AS value, package_id, outcome FROM outcomes UNION ALL SELECT 'split', split, package_id, outcome FROM outcomes UNION ALL SELECT 'role', role, package_id, outcome FROM outcomes)
    SELECT grp, value, count(DISTINCT package_id) AS packages, count(*) AS items, round(avg((outcome = 'valid')::int), 6) AS p_valid, round(avg((outcome = 'ambiguous')::int), 6) AS p_ambiguous,
      round(avg((outcome = 'invalid')::int), 6) AS p_invalid, round(avg((outcome <> 'invalid')::int), 6) AS p_plausible FROM s GROUP BY grp, value""")
def proportions(t: Tables) -> DataFrame:
    p = J.proportions(outcomes(t), ["split", "role"])
    return p.select("grp", "value", "packages", "items", r6("p_valid"), r6("p_ambiguous"), r6("p_invalid"), r6("p_plausible"))


def drawn(seed: int, replicates: int, key: str, table: str) -> str:
    """SQL for (rep, every column of `table`, k): how often a unit occurs in a replicate."""
    hashed = lambda *parts: HASH.format(f"concat_ws('|', '{seed}', {', '.join(parts)})")
    steps = " + ".join(f"(x >= {end})::int" for end in J.POISSON_ENDS)
    return f"""SELECT *, {steps} AS k FROM (SELECT u.*, rep, (h * m + c) % {J.PRIME} AS x FROM (SELECT *, {hashed(key)} % {J.PRIME} AS h FROM {table}) u,
      (SELECT rep, {hashed("'m'", "rep")} % {J.PRIME - 1} + 1 AS m, {hashed("'c'", "rep")} % {J.PRIME} AS c FROM (SELECT unnest(range(0, {replicates})) AS rep)))"""


CTES["packages"] = ("outcomes", """
    SELECT package_id, count(*) AS n, count(*) FILTER (WHERE outcome = 'valid') AS p_valid, count(*) FILTER (WHERE outcome = 'ambiguous') AS p_ambiguous,
      count(*) FILTER (WHERE outcome = 'invalid') AS p_invalid, count(*) FILTER (WHERE outcome IN ('valid', 'ambiguous')) AS p_plausible FROM outcomes GROUP BY package_id""")


@query("cluster_bootstrap_J3", uses="packages", sql=f"""
    WITH d AS ({drawn(11, 10_000, "package_id", "packages")}),
    r AS (SELECT rep, unnest(['p_valid', 'p_ambiguous', 'p_invalid', 'p_plausible']) AS measure,
      unnest([sum(k * p_valid) / sum(k * n), sum(k * p_ambiguous) / sum(k * n), sum(k * p_invalid) / sum(k * n), sum(k * p_plausible) / sum(k * n)]) AS s FROM d GROUP BY rep),
    o AS (SELECT measure, s, row_number() OVER (PARTITION BY measure ORDER BY s) - 1 AS i FROM r)
    SELECT measure, round(max(s) FILTER (WHERE i = 249), 6) AS ci_low, round(max(s) FILTER (WHERE i = 9749), 6) AS ci_high FROM o GROUP BY measure""")
def cluster_bootstrap(t: Tables) -> DataFrame:
    return J.cluster_bootstrap(outcomes(t), "package_id", 10_000, 11).select("measure", r6("ci_low"), r6("ci_high"))


@query("agreement_statistics_J4", uses="outcomes", sql="""
    SELECT count(*) AS items, round(avg((NOT disagreement)::int), 6) AS exact, round(avg((reasonable * (reasonable - 1) + questionable * (questionable - 1) + unreasonable * (unreasonable - 1)) / 6), 6) AS pairwise,
      round((avg((reasonable * reasonable + questionable * questionable + unreasonable * unreasonable - 3) / 6) - any_value(pe)) / (1 - any_value(pe)), 6) AS kappa
    FROM outcomes, (SELECT pow(sum(reasonable) / (3 * count(*)), 2) + pow(sum(questionable) / (3 * count(*)), 2) + pow(sum(unreasonable) / (3 * count(*)), 2) AS pe FROM outcomes)""")
def agreement_statistics(t: Tables) -> DataFrame:
    return J.agreement_statistics(verdicts(t), ["item"]).select("items", r6("exact"), r6("pairwise"), r6("kappa"))


CTES["decoded"] = ("sided", f"""
    SELECT item_id AS item, comparison, assignment, option, CASE WHEN option IN ('TIE', 'D') THEN 'neutral' WHEN option = 'A' THEN a_is WHEN option = 'B' THEN b_is ELSE '' END AS selected,
      CASE WHEN option = 'TIE' THEN 'tie' WHEN option = 'D' THEN 'neither' WHEN option = 'A' THEN CASE WHEN a_is = 'main' THEN 'win' ELSE 'lose' END
        WHEN option = 'B' THEN CASE WHEN b_is = 'main' THEN 'win' ELSE 'lose' END ELSE 'unanswered' END AS outcome FROM (
      SELECT *, item_id || '#' || rater AS assignment, CASE WHEN main_on_a THEN 'main' ELSE 'other' END AS a_is, CASE WHEN main_on_a THEN 'other' ELSE 'main' END AS b_is,
        ['A', 'A', 'A', 'B', 'B', 'TIE', 'D', '?'][{HASH.format("concat_ws('|', 'v2', item_id, rater)")} % 8 + 1] AS option FROM sided)""")


def decoded(t: Tables) -> DataFrame:
    a = assigned(t).withColumn("assignment", F.concat("item_id", F.lit("#"), "rater"))
    blind = a.select("assignment", F.col("item_id").alias("item"), "comparison", F.when(F.col("main_on_a"), "main").otherwise("other").alias("a_is"),
                     F.when(F.col("main_on_a"), "other").otherwise("main").alias("b_is"))
    opts = F.array(*[F.lit(o) for o in ("A", " a", "A", "b", "B", "Tie", "d", "?")])
    def version(v: int) -> DataFrame:
        k = hash60(F.lit(f"v{v}"), F.col("item_id"), F.col("rater")) % 8
        return a.select("assignment", F.element_at(opts, (k + 1).cast("int")).alias("option"), F.lit(v).alias("ord"))
    return J.decode(version(1).unionByName(version(2)), blind, "main")


@query("decode_J5", uses="decoded", sql="SELECT assignment, option, selected, outcome FROM decoded")
def decode(t: Tables) -> DataFrame:
    return decoded(t).select("assignment", "option", "selected", "outcome")


SIGN_SQL = "(SELECT least(1.0, 2 * sum(exp(lgamma(w + l + 1) - lgamma(i + 1) - lgamma(w + l - i + 1) - (w + l) * ln(2.0::double)))) FROM (SELECT unnest(range(0, (least(w, l) + 1)::bigint)) AS i))"


@query("outcome_summary_J6", uses="decoded", sql=f"""
    SELECT comparison, total, w AS win, tie, neither, l AS lose, unanswered, round(w / (w + l), 6) AS decisive_rate, round(w / total, 6) AS win_share, round({SIGN_SQL}, 6) AS p_value FROM (
      SELECT comparison, count(*) AS total, count(*) FILTER (WHERE outcome = 'win') AS w, count(*) FILTER (WHERE outcome = 'tie') AS tie, count(*) FILTER (WHERE outcome = 'neither') AS neither,
        count(*) FILTER (WHERE outcome = 'lose') AS l, count(*) FILTER (WHERE outcome = 'unanswered') AS unanswered FROM decoded GROUP BY comparison)""")
def outcome_summary(t: Tables) -> DataFrame:
    s = J.outcome_summary(decoded(t), ["comparison"])
    return s.select("comparison", "total", "win", "tie", "neither", "lose", "unanswered", r6("decisive_rate"), r6("win_share"), r6("p_value"))


CTES["item_votes"] = ("decoded", """
    SELECT comparison, item, sum(n)::bigint AS judgements, sum(w)::bigint AS wins, sum(l)::bigint AS losses, CASE WHEN sum(w) > sum(l) THEN 'win' WHEN sum(l) > sum(w) THEN 'lose' ELSE 'neutral_or_split' END AS outcome,
      CASE max(n) WHEN 3 THEN '3/3' WHEN 2 THEN '2/3' ELSE 'split' END AS agreement FROM (
      SELECT comparison, item, option, count(*) AS n, count(*) FILTER (WHERE outcome = 'win') AS w, count(*) FILTER (WHERE outcome = 'lose') AS l FROM decoded GROUP BY ALL) GROUP BY comparison, item""")


@query("item_outcomes_J7", uses="item_votes", sql="SELECT * FROM item_votes")
def item_outcomes(t: Tables) -> DataFrame:
    return J.item_outcomes(decoded(t))


@query("item_summary_J7", uses="item_votes", sql=f"""
    SELECT comparison, items, w AS win, l AS lose, round(w / (w + l), 6) AS decisive_rate, round({SIGN_SQL}, 6) AS p_value FROM (
      SELECT comparison, count(*) AS items, count(*) FILTER (WHERE outcome = 'win') AS w, count(*) FILTER (WHERE outcome = 'lose') AS l FROM item_votes GROUP BY comparison)""")
def item_summary(t: Tables) -> DataFrame:
    s = J.item_summary(J.item_outcomes(decoded(t)))
    return s.select("comparison", "items", "win", "lose", r6("decisive_rate"), r6("p_value"))


def choices(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    options = A.blind_options(t.responses.select("example", "system"), "example", "system", 1).withColumnRenamed("system", "method")
    letters = F.array(*[F.lit(o) for o in ("A", "B", "C", "Z")], F.lit(None).cast("string"))
    pick = lambda task: F.struct(F.lit(task).alias("task"), F.element_at(letters, (hash60(F.lit("c"), F.lit(task), F.col("example")) % 5 + 1).cast("int")).alias("selected"))
    rows = t.examples.select("example", F.array(pick("best"), pick("worst")).alias("tasks"))
    info = t.spark.createDataFrame([("best", "positive"), ("worst", "negative")], "task string, polarity string")
    return rows, options, info


CTES["choice_rows"] = ("examples", f"""
    SELECT example, task, ['A', 'B', 'C', 'Z', NULL][{HASH.format("concat_ws('|', 'c', task, example)")} % 5 + 1] AS option FROM examples CROSS JOIN (SELECT unnest(['best', 'worst']) AS task)""")
CTES["option_rows"] = ("responses", f"""
    SELECT example, system AS method, chr((64 + row_number() OVER (PARTITION BY example ORDER BY {HASH.format("concat_ws('|', '1', example, system)")}, system))::int) AS option FROM responses""")


@query("choice_counts_J8", uses="choice_rows option_rows", sql="""
    SELECT task, method, n, round(n / sum(n) OVER (PARTITION BY task), 6) AS rate, CASE task WHEN 'best' THEN 'positive' ELSE 'negative' END AS polarity FROM (
      SELECT task, method, count(*) AS n FROM choice_rows JOIN option_rows USING (example, option) GROUP BY ALL)""")
def choice_counts(t: Tables) -> DataFrame:
    return J.choice_counts(*choices(t)).select("task", "method", "n", r6("rate"), "polarity")


@query("missing_choices_J8", uses="choice_rows", sql="""
    SELECT example, task, CASE WHEN option IS NULL THEN 'not_selected' ELSE 'option_not_found' END AS reason FROM choice_rows WHERE option IS NULL OR option = 'Z'""")
def missing_choices(t: Tables) -> DataFrame:
    rows, options, _ = choices(t)
    return J.missing_choices(rows, options).select("example", "task", "reason")


CTES["deltas"] = ("cands", """
    SELECT a.example, a.gold_ce AS a, b.gold_ce AS b, a.gold_ce - b.gold_ce AS delta, row_number() OVER (ORDER BY a.example) - 1 AS pos FROM cands a JOIN cands b USING (example) WHERE a.system = 'echo' AND b.system = 'trim'""")
CTES["delta_reps"] = ("deltas", f"""
    SELECT rep, sum(k * delta) / sum(k) AS d FROM ({drawn(12, 10_000, "example", "deltas")}) GROUP BY rep""")


def ce_scores(t: Tables) -> DataFrame:
    return scored_candidates(t).select("system", "example", "gold_ce")


@query("bootstrap_mean_J9", uses="deltas delta_reps", sql="""
    SELECT (SELECT count(*) FROM deltas) AS n, round((SELECT avg(delta) FROM deltas), 6) + 0.0 AS mean, round(quantile_cont(d, 0.025), 6) + 0.0 AS ci_low, round(quantile_cont(d, 0.975), 6) + 0.0 AS ci_high FROM delta_reps""")
def bootstrap_mean(t: Tables) -> DataFrame:
    s = ce_scores(t)
    a, b = (s.filter(F.col("system") == n).select("example", F.col("gold_ce").alias(n)) for n in ("echo", "trim"))
    d = a.join(b, "example").withColumn("delta", F.col("echo") - F.col("trim"))
    m = J.bootstrap_mean(d, "delta", ["example"], 10_000, 12)
    return m.select("n", r6("mean"), r6("ci_low"), r6("ci_high"))


@query("wilson_J10", uses="outcomes", sql="""
    SELECT split, k, n, round(greatest(0, (p + z * z / (2 * n) - z * sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)), 6) AS low,
      round(least(1, (p + z * z / (2 * n) + z * sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)), 6) AS high FROM (
      SELECT split, count(*) FILTER (WHERE outcome = 'valid') AS k, count(*) AS n, count(*) FILTER (WHERE outcome = 'valid') / count(*) AS p, 1.959963984540054::double AS z FROM outcomes GROUP BY split)""")
def wilson(t: Tables) -> DataFrame:
    c = outcomes(t).groupBy("split").agg(F.sum((F.col("outcome") == "valid").cast("long")).alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = J.wilson(F.col("k"), F.col("n"))
    return c.select("split", "k", "n", r6(low, "low"), r6(high, "high"))


PAIRED_HEAD = """SELECT (SELECT count(*) FROM deltas) AS n, round((SELECT avg(a) FROM deltas), 6) AS mean_a, round((SELECT avg(b) FROM deltas), 6) AS mean_b, round((SELECT avg(delta) FROM deltas), 6) + 0.0 AS delta,"""


@query("paired_bootstrap_J11", uses="deltas delta_reps", sql=PAIRED_HEAD + """
    round(quantile_cont(d, 0.025), 6) + 0.0 AS ci_low, round(quantile_cont(d, 0.975), 6) + 0.0 AS ci_high, round(least(1.0, 2 * least(avg((d <= 0)::int), avg((d >= 0)::int))), 6) AS p_value FROM delta_reps""")
def paired_bootstrap(t: Tables) -> DataFrame:
    p = J.paired_bootstrap(ce_scores(t), "echo", "trim", "gold_ce", 10_000, 12)
    return p.select("n", *[r6(c) for c in ("mean_a", "mean_b", "delta", "ci_low", "ci_high", "p_value")])


@query("paired_bootstrap_floor_J11", uses="deltas delta_reps", sql=PAIRED_HEAD + """
    round(list_sort(list(d))[250], 6) + 0.0 AS ci_low, round(list_sort(list(d))[9750], 6) + 0.0 AS ci_high,
    round(least(1.0, 2 * CASE WHEN (SELECT avg(delta) FROM deltas) >= 0 THEN avg((d <= 0)::int) ELSE avg((d >= 0)::int) END), 6) AS p_value FROM delta_reps""")
def paired_bootstrap_floor(t: Tables) -> DataFrame:
    p = J.paired_bootstrap(ce_scores(t), "echo", "trim", "gold_ce", 10_000, 12, "floor_tail")
    return p.select("n", *[r6(c) for c in ("mean_a", "mean_b", "delta", "ci_low", "ci_high", "p_value")])


@query("paired_bootstrap_interval_J11", uses="deltas delta_reps", sql=PAIRED_HEAD + """
    round(quantile_cont(d, 0.025), 6) + 0.0 AS ci_low, round(quantile_cont(d, 0.975), 6) + 0.0 AS ci_high, NULL::double AS p_value FROM delta_reps""")
def paired_bootstrap_interval(t: Tables) -> DataFrame:
    p = J.paired_bootstrap(ce_scores(t), "echo", "trim", "gold_ce", 10_000, 12, "linear_only")
    return p.select("n", *[r6(c) for c in ("mean_a", "mean_b", "delta", "ci_low", "ci_high")], "p_value")


CTES["two_sides"] = ("votes soft", """
    SELECT item, label, sum(a) AS a, sum(b) AS b FROM (SELECT item, label, p AS a, 0.0 AS b FROM soft
      UNION ALL SELECT item, label, 0.0, count(*) / 3 FROM votes WHERE annotator > 0 GROUP BY item, label) GROUP BY item, label""")
TERM = "(CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END + CASE WHEN {b} > 0 THEN {b} * log2(2 * {b} / ({a} + {b})) ELSE 0 END)".format(a="a", b="b")
CTES["agreement_rows"] = ("two_sides membership", f"""
    SELECT item, label_jsd, label_overlap, label_top, region_jsd, region_overlap, region_top FROM (
      SELECT item, sum({TERM}) / 2 AS label_jsd, sum(least(a, b)) AS label_overlap, bool_or(abs(a - ma) <= 1e-12 AND abs(b - mb) <= 1e-12) AS label_top FROM (
        SELECT *, max(a) OVER (PARTITION BY item) AS ma, max(b) OVER (PARTITION BY item) AS mb FROM two_sides) GROUP BY item)
    JOIN (SELECT item, sum({TERM}) / 2 AS region_jsd, sum(least(a, b)) AS region_overlap, bool_or(abs(a - ma) <= 1e-9 AND abs(b - mb) <= 1e-9) AS region_top FROM (
        SELECT *, max(a) OVER (PARTITION BY item) AS ma, max(b) OVER (PARTITION BY item) AS mb FROM (
          SELECT item, region, sum(a * m) AS a, sum(b * m) AS b FROM two_sides JOIN membership USING (label) GROUP BY item, region)) GROUP BY item) USING (item)""")


def two_sides(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    human = sl.strict_distribution(t.votes.filter("annotator > 0"), t.membership, ITEM, weighted=False)
    dense = mem.dense_regions(t.membership.withColumnRenamed("m", "p"), ["label"], REGIONS, "m")
    return t.soft, human, dense


def agreement_rows(t: Tables) -> DataFrame:
    return J.sample_agreement(*two_sides(t), ITEM, REGIONS)


@query("sample_agreement_J12", uses="agreement_rows", sql="""
    SELECT item, round(label_jsd, 6) + 0.0 AS label_jsd, round(label_overlap, 6) AS label_overlap, label_top, round(region_jsd, 6) + 0.0 AS region_jsd, round(region_overlap, 6) AS region_overlap, region_top FROM agreement_rows""")
def sample_agreement(t: Tables) -> DataFrame:
    return agreement_rows(t).select("item", r6("label_jsd"), r6("label_overlap"), "label_top", r6("region_jsd"), r6("region_overlap"), "region_top")


CTES["loo_rows"] = ("votes membership", """
    WITH h AS (SELECT item, row_number() OVER (PARTITION BY item ORDER BY annotator, label) AS annotator, label FROM votes WHERE annotator > 0),
    z AS (SELECT h.item, h.annotator, g.region, coalesce(m.m, 0) AS x FROM h CROSS JOIN (SELECT DISTINCT region FROM membership) g LEFT JOIN membership m ON m.label = h.label AND m.region = g.region),
    pairs AS (SELECT a.item, a.annotator, a.region, a.x, avg(b.x) AS y FROM z a JOIN z b ON a.item = b.item AND a.region = b.region AND a.annotator <> b.annotator GROUP BY ALL),
    r AS (SELECT item, annotator, sum(CASE WHEN x > 0 THEN x * log2(2 * x / (x + y)) ELSE 0 END + CASE WHEN y > 0 THEN y * log2(2 * y / (x + y)) ELSE 0 END) / 2 AS region_jsd,
      sum(least(x, y)) AS region_overlap FROM pairs GROUP BY ALL),
    l AS (SELECT a.item, a.annotator, avg((a.label = b.label)::int) AS s FROM h a JOIN h b ON a.item = b.item AND a.annotator <> b.annotator GROUP BY ALL)
    SELECT item, count(*)::bigint AS raters, avg((log2(2 / (1 + s)) + CASE WHEN s > 0 THEN s * log2(2 * s / (1 + s)) ELSE 0 END + 1 - s) / 2) AS loo_label_jsd, avg(s) AS loo_label_overlap,
      avg(region_jsd) AS loo_region_jsd, avg(region_overlap) AS loo_region_overlap FROM l JOIN r USING (item, annotator) GROUP BY item""")
LOO = ["loo_label_jsd", "loo_label_overlap", "loo_region_jsd", "loo_region_overlap"]


@query("leave_one_out_J12", uses="loo_rows", sql="SELECT item, raters, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in LOO) + " FROM loo_rows")
def leave_one_out(t: Tables) -> DataFrame:
    return J.leave_one_out(t.votes.filter("annotator > 0"), two_sides(t)[2], ITEM, REGIONS).select("item", "raters", *[r6(c) for c in LOO])


CTES["weighted_sides"] = ("votes soft", """
    SELECT item, label, sum(a) AS a, sum(b) AS b FROM (SELECT item, label, p AS a, 0.0 AS b FROM soft UNION ALL
      SELECT item, label, 0.0, sum(confidence) / any_value(total) FROM (SELECT *, sum(confidence) OVER (PARTITION BY item) AS total FROM votes WHERE annotator > 0) GROUP BY item, label) GROUP BY item, label""")
ROBUST = ["label_jsd", "region_jsd", "label_overlap", "region_overlap"]
CTES["robust_rows"] = ("two_sides weighted_sides membership", f"""
    WITH s AS (SELECT 'unweighted' AS how, * FROM two_sides UNION ALL SELECT 'confidence_weighted', * FROM weighted_sides)
    SELECT * FROM (SELECT how, item, sum({TERM}) / 2 AS label_jsd, sum(least(a, b)) AS label_overlap FROM s GROUP BY how, item)
    JOIN (SELECT how, item, sum({TERM}) / 2 AS region_jsd, sum(least(a, b)) AS region_overlap FROM (
      SELECT how, item, region, sum(a * m) AS a, sum(b * m) AS b FROM s JOIN membership USING (label) GROUP BY how, item, region) GROUP BY how, item) USING (how, item)""")


@query("agreement_robustness_J12", uses="robust_rows", sql="SELECT item, how AS human_aggregation, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ROBUST) + " FROM robust_rows")
def agreement_robustness(t: Tables) -> DataFrame:
    model, plain, dense = two_sides(t)
    weighted = sl.strict_distribution(t.votes.filter("annotator > 0"), t.membership, ITEM)
    return J.robustness_rows(model, {"unweighted": plain, "confidence_weighted": weighted}, dense, ITEM, REGIONS).select("item", "human_aggregation", *[r6(c) for c in ROBUST])


def _interval_sql(c: str) -> str:
    return f"round(quantile_cont({c}, 0.025), 6) + 0.0 AS ci_low_{c}, round(quantile_cont({c}, 0.975), 6) + 0.0 AS ci_high_{c}"


def _rate_sql(c: str) -> str:
    p, z = f"avg({c}::int)", J.Z95
    centre, margin = f"({p} + {z * z} / (2 * count(*)))", f"{z} * sqrt(({p} * (1 - {p}) + {z * z} / (4 * count(*))) / count(*))"
    return f"""round({p}, 6) AS {c}_rate, round(greatest(0, ({centre} - {margin}) / (1 + {z * z} / count(*))), 6) AS {c}_low,
      round(least(1, ({centre} + {margin}) / (1 + {z * z} / count(*))), 6) AS {c}_high"""


AGREEMENT_REPLICATES = 10_000
CTES["agreement_strata"] = ("agreement_rows strata", "SELECT a.*, region_jsd - label_jsd AS projection_delta, stratum FROM agreement_rows a JOIN strata USING (item)")


@query("agreement_by_stratum_J12", uses="agreement_strata", sql=f"""
    WITH d AS ({drawn(14, AGREEMENT_REPLICATES, "item", "agreement_strata")}),
    q AS (SELECT coalesce(stratum, 'all') AS grp, rep, {", ".join(f"sum(k * {c}) / sum(k) AS {c}" for c in J.AGREEMENT_MEASURES)} FROM d GROUP BY GROUPING SETS ((stratum, rep), (rep))),
    i AS (SELECT grp, {", ".join(_interval_sql(c) for c in J.AGREEMENT_MEASURES)} FROM q GROUP BY grp),
    g AS (SELECT coalesce(stratum, 'all') AS grp, count(*) AS n, {", ".join(f"round(avg({c}), 6) + 0.0 AS mean_{c}" for c in J.AGREEMENT_MEASURES)}, {_rate_sql("label_top")}, {_rate_sql("region_top")}
      FROM agreement_strata GROUP BY GROUPING SETS ((stratum), ()))
    SELECT * FROM g JOIN i USING (grp)""")
def agreement_by_stratum(t: Tables) -> DataFrame:
    rows = agreement_rows(t).join(strata(t).select("item", "stratum"), "item")
    a = J.agreement_by_stratum(rows, "stratum", ITEM, AGREEMENT_REPLICATES, 14)
    return a.select("grp", "n", *[r6(c) for c in a.columns[2:]])


PERMUTATIONS = 1_000
CTES["perm_base"] = ("two_sides membership strata", f"""
    SELECT stratum, perm, avg(jsd) AS mean_jsd FROM (SELECT i.item, unnest([s.stratum, 'all']) AS stratum, perm, jsd FROM (
      SELECT item, perm, least(1, greatest(0, sum({TERM}) / 2)) AS jsd FROM (
        SELECT item, perm, region, sum(a * m) AS a, sum(b * m) AS b FROM two_sides t JOIN (
          SELECT 0 AS perm, l AS label, l AS source FROM range(0, 24) r(l) UNION ALL
          SELECT perm, rk AS label, l AS source FROM (SELECT p AS perm, l, row_number() OVER (PARTITION BY p ORDER BY {HASH.format("concat_ws('|', '13', p, l)")}, l) - 1 AS rk
            FROM range(1, {PERMUTATIONS + 1}) x(p) CROSS JOIN range(0, 24) y(l))) q ON q.label = t.label JOIN membership m ON m.label = q.source GROUP BY item, perm, region) GROUP BY item, perm) i JOIN strata s USING (item))
    GROUP BY stratum, perm""")


def perm_base(t: Tables) -> DataFrame:
    model, human, dense = two_sides(t)
    return J.permutation_baseline(model, human, dense, PERMUTATIONS, strata(t), REGIONS, 13)


@query("permutation_baseline_J13", uses="perm_base", sql="SELECT stratum, perm::bigint AS perm, round(mean_jsd, 6) AS mean_jsd FROM perm_base")
def permutation_baseline(t: Tables) -> DataFrame:
    return perm_base(t).select("stratum", "perm", r6("mean_jsd"))


@query("permutation_summary_J13", uses="perm_base", sql="""
    SELECT stratum, round(any_value(g), 6) AS given, round(avg(mean_jsd), 6) AS random_mean, round(stddev_pop(mean_jsd), 6) AS random_std, round(quantile_cont(mean_jsd, 0.025), 6) AS p025,
      round((count(*) FILTER (WHERE mean_jsd <= g) + 1) / (count(*) + 1), 6) AS p_value FROM perm_base JOIN (SELECT stratum, mean_jsd AS g FROM perm_base WHERE perm = 0) USING (stratum) WHERE perm > 0 GROUP BY stratum""")
def permutation_summary(t: Tables) -> DataFrame:
    return J.permutation_summary(perm_base(t)).select("stratum", r6("given"), r6("random_mean"), r6("random_std"), r6("p025"), r6("p_value"))


@query("timing_summary_J14", sql="""
    WITH t AS (SELECT o_orderpriority AS config, o_totalprice / 100000 AS g, 0.02::double AS s, 0.001::double AS c FROM orders),
    a AS (SELECT config, count(*) AS n, sum(g + s + c) AS total, avg(s + c) AS oh, quantile_cont(g, 0.5) AS q50, quantile_cont(g, 0.95) AS q95 FROM t GROUP BY config)
    SELECT config, n, round(total / n * 1000, 4) AS mean_ms, round((q50 + oh) * 1000, 4) AS p50_ms, round((q95 + oh) * 1000, 4) AS p95_ms, round(n / total, 6) AS examples_per_s,
      round(total / (SELECT total FROM a WHERE config = '1-URGENT'), 6) AS relative_cost FROM a""")
def timing_summary(t: Tables) -> DataFrame:
    rows = t.read("orders").select(F.col("o_orderpriority").alias("config"), F.lit(4).alias("candidates"), (F.col("o_totalprice") / 100000).alias("generation_s"),
                                   F.lit(0.02).alias("scoring_s"), F.lit(0.001).alias("selection_s"))
    s = J.timing_summary(rows, ["config"], "1-URGENT")
    return s.select("config", "n", F.round("mean_ms", 4).alias("mean_ms"), F.round("p50_ms", 4).alias("p50_ms"), F.round("p95_ms", 4).alias("p95_ms"), r6("examples_per_s"), r6("relative_cost"))


# ---- result tables -----------------------------------------------------------------------------------------

CTES["run_metrics"] = ("cands", """
    SELECT system, split, avg(gold_ce) AS ce, avg((y = yhat)::int) AS accuracy, avg(control_ce) AS control_ce, count(*) AS n FROM cands GROUP BY system, split""")


def run_metrics(t: Tables) -> DataFrame:
    rows = M.row_metrics(candidates(t)).withColumn("control_ce", D.soft_cross_entropy(F.col("control"), F.col("pred")))
    hit = F.avg((F.col("y") == F.col("yhat")).cast("double"))
    return rows.groupBy("system", "split").agg(F.avg("ce").alias("ce"), hit.alias("accuracy"), F.avg("control_ce").alias("control_ce"), F.count(F.lit(1)).alias("n"))


def long_metrics(t: Tables) -> DataFrame:
    return run_metrics(t).unpivot(["system", "split"], ["ce", "accuracy", "control_ce"], "metric", "value")


@query("over_seeds_B1", uses="run_metrics", sql="""
    SELECT system, count(*) AS n, round(avg(ce), 6) AS mean, round(stddev_pop(ce), 6) AS std_pop, round(stddev_samp(ce), 6) AS std_sample FROM run_metrics GROUP BY system""")
def over_seeds(t: Tables) -> DataFrame:
    o = B.over_seeds(run_metrics(t), ["system"], "ce")
    return o.select("system", "n", r6("mean"), r6("std_pop"), r6("std_sample"))


@query("seed_summary_B2", uses="responses", sql="""
    WITH x AS (SELECT system, split, len(list_filter(string_split_regex(response, '\\s+'), lambda x: x <> '')) AS w FROM responses)
    SELECT system, split, count(*) AS n, round(avg(w), 6) AS mean_words, round(stddev_samp(w), 6) AS std_words, round(median(w), 6) AS median_words, min(w) AS min_words, max(w) AS max_words,
      round(avg((w < 18)::int), 6) AS too_short_rate, round(avg((w > 32)::int), 6) AS too_long_rate FROM x GROUP BY system, split""")
def seed_summary(t: Tables) -> DataFrame:
    s = B.seed_summary(t.responses, ["system", "split"], "response")
    return s.select("system", "split", "n", r6("mean_words"), r6("std_words"), r6("median_words"), "min_words", "max_words", r6("too_short_rate"), r6("too_long_rate"))


def metric_trees(t: Tables) -> DataFrame:
    """One nested JSON metric tree per run (system)."""
    m = run_metrics(t)
    entry = F.struct("split", F.struct(F.struct("ce", "accuracy").alias("vs_gold"), F.col("control_ce").alias("control_ce")).alias("block"))
    tree = m.groupBy("system").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("tree"))  # three splits per run
    return tree.select("system", F.to_json("tree").alias("tree"))


@query("flatten_metrics_B4", uses="run_metrics", sql="""
    SELECT system, split || '.vs_gold.ce' AS path, round(ce, 6) AS value FROM run_metrics UNION ALL SELECT system, split || '.vs_gold.accuracy', round(accuracy, 6) FROM run_metrics
    UNION ALL SELECT system, split || '.control_ce', round(control_ce, 6) FROM run_metrics""")
def flatten_metrics(t: Tables) -> DataFrame:
    return B.flatten_metrics(metric_trees(t), ["system"], "tree").filter("value IS NOT NULL").select("system", "path", r6("value"))


@query("run_rollup_B3", uses="run_metrics", sql="""
    SELECT 'ce' AS metric, count(*) AS n, round(avg(ce), 6) AS mean, round(stddev_pop(ce), 6) AS std_pop FROM run_metrics WHERE split = 'test'
    UNION ALL SELECT 'accuracy', count(*), round(avg(accuracy), 6), round(stddev_pop(accuracy), 6) FROM run_metrics WHERE split = 'test'""")
def run_rollup(t: Tables) -> DataFrame:
    r = B.run_rollup(B.flatten_metrics(metric_trees(t), ["system"], "tree"), [], "test", "vs_gold", ["ce", "accuracy"])
    return r.select("metric", "n", r6("mean"), r6("std_pop"))


@query("best_variant_B3", uses="run_metrics", sql="""
    SELECT split, arg_min(system, (round(ce, 12), system)) AS system, round(min(ce), 6) AS ce FROM run_metrics GROUP BY split""")
def best_variant(t: Tables) -> DataFrame:
    return B.best_variant(run_metrics(t), ["split"], "system", "ce").select("split", "system", r6("ce"))


@query("wide_rows_B4", uses="run_metrics", sql="""
    SELECT system, round(max(ce) FILTER (WHERE split = 'test'), 6) AS test_vs_gold_ce, round(max(control_ce) FILTER (WHERE split = 'train'), 6) AS train_control_ce FROM run_metrics GROUP BY system""")
def wide_rows(t: Tables) -> DataFrame:
    w = B.wide_rows(B.flatten_metrics(metric_trees(t), ["system"], "tree"), ["system"], ["test.vs_gold.ce", "train.control_ce"])
    return w.select("system", r6("test_vs_gold_ce"), r6("train_control_ce"))


@query("best_per_metric_B5", uses="run_metrics", sql="""
    WITH l AS (SELECT system, 'ce' AS metric, ce AS value, -ce AS s FROM run_metrics WHERE split = 'train' UNION ALL SELECT system, 'accuracy', accuracy, accuracy FROM run_metrics WHERE split = 'train')
    SELECT metric, system, round(value, 6) AS value FROM l JOIN (SELECT metric, max(s) AS b FROM l GROUP BY metric) USING (metric) WHERE abs(s - b) <= 1e-12""")
def best_per_metric(t: Tables) -> DataFrame:
    rows = long_metrics(t).filter("split = 'train' AND metric <> 'control_ce'")
    return B.best_per_metric(rows, ["accuracy"]).select("metric", "system", r6("value"))


@query("reproduction_check_B6", uses="run_metrics", sql="""
    SELECT system, split, round(1.5, 6)::double AS expected, round(ce, 6) AS observed, round(abs(ce - 1.5), 6) AS difference, abs(ce - 1.5) <= 0.05 AS within FROM run_metrics""")
def reproduction_check(t: Tables) -> DataFrame:
    m = run_metrics(t)
    r = B.reproduction_check(m.select("system", "split", F.col("ce").alias("observed")), m.select("system", "split", F.lit(1.5).alias("expected")), ["system", "split"], 0.05)
    return r.select("system", "split", "expected", r6("observed"), r6("difference"), "within")


@query("side_by_side_B7", uses="run_metrics", sql="""
    SELECT split, round(max(ce) FILTER (WHERE system = 'echo'), 6) AS echo_ce, round(max(accuracy) FILTER (WHERE system = 'echo'), 6) AS echo_accuracy,
      round(max(ce) FILTER (WHERE system = 'trim'), 6) AS trim_ce, round(max(accuracy) FILTER (WHERE system = 'trim'), 6) AS trim_accuracy FROM run_metrics GROUP BY split""")
def side_by_side(t: Tables) -> DataFrame:
    m = run_metrics(t)
    s = B.side_by_side({n: m.filter(F.col("system") == n) for n in ("echo", "trim")}, ["split"], ["ce", "accuracy"])
    return s.select("split", *[r6(c) for c in ("echo_ce", "echo_accuracy", "trim_ce", "trim_accuracy")])


@query("registry_B8", uses="run_metrics", sql="""
    SELECT 'main' AS experiment, system, split, round(ce, 6) AS ce, 'primary' AS note FROM run_metrics WHERE system <> 'echo' UNION ALL SELECT 'baseline', system, split, round(ce, 6), '' FROM run_metrics WHERE system = 'echo'""")
def registry_rows(t: Tables) -> DataFrame:
    m = run_metrics(t)
    r = B.registry({"main": m.filter("system <> 'echo'"), "baseline": m.filter("system = 'echo'")}, {"main": "primary"})
    return r.select("experiment", "system", "split", r6("ce"), "note")


@query("missing_runs_B8", uses="run_metrics responses", sql="""
    SELECT DISTINCT system, split FROM responses EXCEPT SELECT system, split FROM run_metrics WHERE accuracy > 0.5""")
def missing_runs(t: Tables) -> DataFrame:
    return B.missing_runs(t.responses, run_metrics(t).filter("accuracy > 0.5"), ["system", "split"])


@query("generation_vs_targets_E12", uses="cands resp_toks", sql="""
    WITH c AS (SELECT *, CASE WHEN system <> 'echo' THEN control_ce END AS cc FROM cands)
    SELECT system, count(*) AS n, round(avg(gold_ce), 6) AS gold_ce, round(avg(gold_kl), 6) AS gold_kl, round(avg((y = yhat)::int), 6) AS gold_accuracy, round(avg(cc), 6) AS control_ce,
      round(any_value(ml), 6) AS mean_length FROM c JOIN (SELECT system, avg(len(h)) AS ml FROM resp_toks GROUP BY system) USING (system) GROUP BY system""")
def generation_vs_targets(t: Tables) -> DataFrame:
    c = candidates(t).withColumn("control", F.when(F.col("system") != "echo", F.col("control")))
    gold = M.metric_block(M.row_metrics(c), ["system"], REGIONS).select("system", "n", F.col("ce").alias("gold_ce"), F.col("kl").alias("gold_kl"), F.col("accuracy").alias("gold_accuracy"))
    ctl = M.metric_block(M.row_metrics(c.filter("control is not null"), "control"), ["system"], REGIONS).select("system", F.col("ce").alias("control_ce"))
    text = TM.diagnostics(c, ["system"], "response")
    j = TM.join_all([gold, ctl, text], ["system"])
    return j.select("system", "n", r6("gold_ce"), r6("gold_kl"), r6("gold_accuracy"), r6("control_ce"), r6("mean_length"))
