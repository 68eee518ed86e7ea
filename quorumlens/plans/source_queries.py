"""Queries for sources and sinks (S): the driver tables brought into each source shape, then read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sequence as seq
from ..sources import scans as S
from ..sources import sinks as W
from ..streaming import resume
from .fixtures import ITEM, REGIONS, Tables, r6
from .registry import query
from .space_queries import counts, label_cosines

NAMES = ["m0", "m1", "m2", "m3"]


def named_votes(t: Tables) -> DataFrame:
    name = F.concat(F.lit("m"), F.col("annotator"))
    return t.votes.join(t.turns.select("item", "text"), "item").withColumn("annotator", name)


def nested(t: Tables) -> DataFrame:
    """Votes folded into the nested conversation shape, one record per (annotator, conversation)."""
    ann = F.struct(F.col("label").cast("string").alias("selected_emoji"), F.when(F.col("confidence") < 5, F.col("confidence")).cast("string").alias("confidence"))
    turn = F.struct("turn", F.struct(F.col("turn").cast("string").alias("turn_id"), F.when(F.col("role") == "A", "speaker").otherwise("Listener").alias("speaker"),
                                     F.col("text").alias("utterance"), ann.alias("emoji_annotation")).alias("t"))
    rec = named_votes(t).groupBy("annotator", "split", "conv_id").agg(F.transform(F.sort_array(F.collect_list(turn)), lambda x: x["t"]).alias("turns"))
    js = F.to_json(F.struct(F.col("conv_id").cast("string").alias("dialogue_id"), F.upper("split").alias("split"), F.lit("none").alias("situation"), "turns"))
    parsed = rec.select("annotator", F.from_json(js, S.NESTED_SCHEMA).alias("r"))
    return parsed.select("r.*", F.col("annotator").alias("_annotator"), F.lit("train").alias("_split"))


@query("nested_scan_S1_S3", uses="votes turns", sql="""
    SELECT 'm' || annotator AS annotator, v.conv_id::varchar AS conv_id, v.turn, CASE v.split WHEN 'valid' THEN 'dev' ELSE v.split END AS split, v.role, label::varchar AS label,
      CASE WHEN confidence < 5 THEN confidence ELSE 1 END::double AS confidence, md5(t.text) AS text_md5 FROM votes v JOIN turns t USING (item)""")
def nested_scan(t: Tables) -> DataFrame:
    f = S.flatten_dialogues(nested(t))
    return f.select("annotator", "conv_id", "turn", "split", "role", "label", "confidence", F.md5("text").alias("text_md5"))


@query("flat_votes_S2", uses="votes", sql="""
    SELECT conv_id::varchar AS conv_id, turn, CASE split WHEN 'valid' THEN 'dev' ELSE split END AS split, role, 'm' || annotator AS annotator, label::varchar AS label, confidence::double AS confidence FROM votes""")
def flat_votes(t: Tables) -> DataFrame:
    raw = named_votes(t).select(F.col("conv_id").alias("dialogue_id"), F.col("turn").alias("turn_id"), "split", F.lower("role").alias("role"), "text", F.col("annotator").alias("model"),
                                F.col("label").cast("string").alias("emoji"), "confidence")
    return S.as_votes(raw).drop("text")


def maps(t: Tables) -> DataFrame:
    v = named_votes(t).filter("NOT (turn = 1 AND annotator = 'm2')").withColumn("ord", F.lit(0))
    return S.merged_single_annotator(v)


@query("model_maps_S4", uses="votes", sql="""
    SELECT conv_id, turn, 'm' || annotator AS annotator, label, confidence::double AS confidence FROM votes WHERE turn <> 0 AND NOT (turn = 1 AND annotator = 2)""")
def model_maps(t: Tables) -> DataFrame:
    models = F.when(F.col("turn") > 0, F.array(*[F.lit(n) for n in NAMES])).otherwise(F.array())
    rows = maps(t).select("conv_id", "turn", models.alias("models"), F.col("labels").alias("model_emojis"), F.col("confidences").alias("model_confidences"))
    return S.from_model_maps(rows).select("conv_id", "turn", "annotator", "label", "confidence")


@query("turn_maps_S5", uses="votes", sql="""
    SELECT conv_id, turn, 'm' || annotator AS annotator, label, confidence::double AS confidence FROM votes WHERE NOT (turn = 1 AND annotator = 2)""")
def turn_maps(t: Tables) -> DataFrame:
    m = maps(t).join(t.turns.select("conv_id", "turn", "role", "text"), ["conv_id", "turn"])
    e = F.struct("turn", "role", "text", F.col("labels").alias("emoji"), F.col("confidences").alias("confidence"))
    # Map values make the struct unordered, so turns are placed by their number.
    entries = m.groupBy("split", "conv_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("turn"), e.alias("v")))).alias("_m"))
    d = entries.select("split", "conv_id", F.transform(F.sort_array(F.map_keys("_m")), lambda k: F.element_at("_m", k)).alias("turns"))
    return S.from_turn_maps(d).select("conv_id", "turn", "annotator", "label", "confidence")


@query("single_annotator_merge_S6", uses="votes", sql="""
    SELECT conv_id, turn, string_agg('m' || annotator || '=' || CASE WHEN annotator = 1 THEN label + 100 ELSE label END, ',' ORDER BY annotator) AS labels FROM votes GROUP BY conv_id, turn""")
def single_annotator_merge(t: Tables) -> DataFrame:
    v = named_votes(t).withColumn("ord", F.lit(0))
    later = v.filter("annotator = 'm1'").withColumns({"label": F.col("label") + 100, "ord": F.lit(1)})
    m = S.merged_single_annotator(v.unionByName(later))
    text = F.array_join(F.transform(F.sort_array(F.map_keys("labels")), lambda k: F.concat(k, F.lit("="), F.element_at("labels", k).cast("string"))), ",")
    return m.select("conv_id", "turn", text.alias("labels"))


def stored_soft(t: Tables) -> DataFrame:
    return t.soft.select("item", "label", (F.col("p") * 0.5).cast("string").alias("soft_prob"), F.when(F.col("label") % 5 != 0, F.col("row_conf")).alias("mean_confidence"),
                         F.when(F.col("label") % 3 != 0, F.col("support")).alias("support"))


@query("soft_label_table_S7", uses="soft", sql="""
    SELECT item, round(-sum(p * log2(p)), 6) + 0.0 AS entropy_bits, count(*) AS nonzero, arg_min(label, (-round(p, 12), label)) AS top_label, round(max(p), 6) AS top_p,
      round(CASE WHEN sum(CASE WHEN c IS NOT NULL THEN n END) > 0 THEN sum(c * n) / sum(CASE WHEN c IS NOT NULL THEN n END) ELSE sum(c * p) / sum(CASE WHEN c IS NOT NULL THEN p END) END, 6) AS mean_conf
    FROM (SELECT *, CASE WHEN label % 5 <> 0 THEN row_conf END AS c, CASE WHEN label % 3 <> 0 THEN support END AS n FROM soft) GROUP BY item""")
def soft_label_table(t: Tables) -> DataFrame:
    s = S.soft_label_table(stored_soft(t), ITEM)
    return s.select("item", r6("entropy_bits"), "nonzero", "top_label", r6("top_p"), r6("mean_conf"))


@query("membership_scan_S8", uses="votes", sql="""
    SELECT label, label % 6 AS region, round(sum(CASE WHEN confidence = 3 THEN 0.25 ELSE confidence / 10 END), 6) AS m FROM votes WHERE confidence > 1 GROUP BY label""")
def membership_scan(t: Tables) -> DataFrame:
    c = F.col("confidence")
    rows = t.votes.select("label", (F.col("label") % 6).alias("region"), F.when(c == 3, "").when(c == 1, "-1").otherwise((c / 10).cast("string")).alias("membership_raw"),
                          F.lit("0.25").alias("membership_prob"))
    return S.membership(rows).select("label", "region", r6("m"))


@query("lenient_membership_S9", uses="votes", sql="""
    WITH m AS (SELECT label, turn % 5 AS region, max(greatest(confidence - 3, 0))::double AS m FROM votes GROUP BY ALL),
    t AS (SELECT label, sum(m) AS s FROM m GROUP BY label)
    SELECT l.label, r.region, round(coalesce(m.m, 0) / t.s, 6) AS m, (SELECT count(*) FROM (SELECT label FROM votes WHERE confidence < 3)) AS negatives
    FROM (SELECT DISTINCT label FROM m) l CROSS JOIN (SELECT DISTINCT region FROM m) r LEFT JOIN m USING (label, region) JOIN t ON t.label = l.label WHERE t.s > 0""")
def lenient_membership(t: Tables) -> DataFrame:
    rows = t.votes.select("label", (F.col("turn") % 5).alias("region"), (F.col("confidence") - 3).cast("double").alias("m"))
    good, bad = S.lenient_membership(rows)
    n = bad.filter("rule = 'negative'").agg(F.count(F.lit(1)).alias("negatives"))
    return good.crossJoin(F.broadcast(n)).select("label", "region", r6("m"), "negatives")  # one-row side


@query("stance_space_S10", uses="membership label_vectors", sql="""
    WITH g AS (SELECT l AS label, r AS region, coalesce(m, 0) AS m FROM range(0, 24) x(l) CROSS JOIN range(0, 6) y(r) LEFT JOIN membership ON membership.label = l AND membership.region = r)
    SELECT form, label::varchar AS label, round(max(m) FILTER (WHERE region = 2), 6) AS m2, round(CASE WHEN label % 2 = 0 THEN (SELECT x FROM label_vectors v WHERE v.label = g.label AND d = 1)
      ELSE max(m) FILTER (WHERE region = 1) END, 6) + 0.0 AS v1 FROM g CROSS JOIN (SELECT unnest(['long', 'wide', 'nested']) AS form) GROUP BY form, label""")
def stance_space(t: Tables) -> DataFrame:
    m = t.membership.join(t.votes.select("label").distinct(), "label").withColumn("label", F.col("label").cast("string"))
    vec = t.label_vectors.filter("label % 2 = 0").select(F.col("label").cast("string").alias("label"), "v")
    long = S.long_supports(m.select("label", F.concat(F.lit("cluster_0"), "region").alias("cluster_id"), F.col("m").cast("string").alias("membership_raw")))
    wide = S.wide_supports(W.wide_matrix(m, "label", "region", "m", list(range(REGIONS))).select("label", *[F.col(str(r)).alias(f"raw_cluster_{r}") for r in range(REGIONS)]))
    first = m.groupBy("label").agg(F.min("region").alias("_r"))
    # The first region has support 1 in this form, the others follow in proportion to it.
    j = m.join(first, "label").withColumn("_own", F.col("region") == F.col("_r"))
    own = m.join(first.withColumnRenamed("_r", "region"), ["label", "region"]).select("label", F.col("region").alias("cluster"), F.col("m").alias("_base"))
    rest = j.filter("NOT _own").join(own, "label").groupBy("label").agg(F.collect_list(F.struct(F.col("region").cast("string").alias("cluster"), (F.col("m") / F.col("_base")).alias("support"))).alias("candidateClusters"))
    nested_form = S.nested_supports(own.join(rest, "label", "left").withColumn("cluster", F.concat(F.lit("c"), "cluster")))
    parts = [S.stance_space(s, vec).withColumn("form", F.lit(n)) for n, s in (("long", long), ("wide", wide), ("nested", nested_form))]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("form", "label", r6(F.element_at("membership", 3), "m2"), r6(F.element_at("vector", 2), "v1"))


@query("vector_column_S11", sql="""
    SELECT vec_id, vec_id % 10 <> 3 AS good, CASE WHEN vec_id % 10 = 3 THEN NULL ELSE round(list_sum(list_transform(embedding, lambda x: x::double)), 4) + 0.0 END AS total FROM embeddings""")
def vector_column(t: Tables) -> DataFrame:
    e = t.read("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    text = F.to_json(F.when(F.col("vec_id") % 10 == 3, F.slice("v", 1, 60)).otherwise(F.col("v")))
    good, bad = S.vector_column(e.select("vec_id", text.alias("j")), ["vec_id"], "j")
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    a = good.select("vec_id", F.lit(True).alias("good"), (F.round(total, 4) + F.lit(0.0)).alias("total"))
    return a.unionByName(bad.select("vec_id", F.lit(False).alias("good"), F.lit(None).cast("double").alias("total")))


@query("wide_matrix_S12", uses="full_counts", sql="""
    SELECT source, """ + ", ".join(f'round(max(wn) FILTER (WHERE target = {k}), 6) AS r{k}' for k in range(REGIONS)) + """ FROM full_counts WHERE pair = 'B2A' GROUP BY source""")
def wide_matrix(t: Tables) -> DataFrame:
    w = W.wide_matrix(counts(t).filter("pair = 'B2A'"), "source", "target", "wn", list(range(REGIONS)))
    return w.select("source", *[r6(str(k), f"r{k}") for k in range(REGIONS)])


def exported(t: Tables) -> DataFrame:
    v = named_votes(t).withColumn("label", F.when(~((F.col("annotator") == "m3") & (F.col("turn") == 2)), F.chr(F.lit(65) + F.col("label"))))
    return W.metadata_turns(v)


@query("metadata_export_S13", uses="votes", sql="""
    SELECT 'm' || annotator AS annotator, split, count(DISTINCT conv_id) AS conversations, count(*) FILTER (WHERE kept) AS turns,
      min('U+' || lpad(upper(hex(chr((65 + label)::int)::varchar)), 4, '0')) FILTER (WHERE kept) AS first_code,
      sum(confidence) FILTER (WHERE kept)::bigint AS confidence FROM (SELECT *, NOT (annotator = 3 AND turn = 2) AS kept FROM votes) GROUP BY annotator, split""")
def metadata_export(t: Tables) -> DataFrame:
    turns = exported(t)
    m = W.manifest(W.metadata_records(turns))
    per = turns.groupBy("annotator", "split").agg(
        F.count("label").alias("turns"), F.min("unicode").alias("first_code"), F.sum(F.when(F.col("label").isNotNull(), F.col("confidence"))).alias("confidence"))
    return m.drop("content_sha256").join(per, ["annotator", "split"])


@query("manifest_S13")
def manifest(t: Tables) -> DataFrame:
    return W.manifest(W.metadata_records(exported(t)))


def source_rows(t: Tables) -> DataFrame:
    return t.turns.select("conv_id", (F.col("turn") * 3 + 1).alias("utterance_idx"), F.when(F.col("role") == "A", "x7").otherwise("x2").alias("speaker_idx"),
                          F.regexp_replace("text", ",", "_comma_").alias("utterance"), F.lit("p _comma_ q").alias("prompt"))


@query("reconstruct_S14", uses="turns", sql=r"""
    WITH f AS (SELECT conv_id, arg_min(role, turn) AS r FROM turns GROUP BY conv_id), s AS (SELECT t.*, CASE WHEN t.role = f.r THEN 'A' ELSE 'B' END AS speaker FROM turns t JOIN f USING (conv_id)),
    m AS (SELECT conv_id, turn, CASE WHEN turn = 4 THEN 'Z' ELSE speaker END AS sp FROM s WHERE turn <> 2 UNION ALL SELECT conv_id + 100000, turn, 'A' FROM s WHERE turn = 0 UNION ALL SELECT conv_id, 99, 'A' FROM s WHERE turn = 1)
    SELECT m.conv_id, m.turn, CASE WHEN m.conv_id >= 100000 THEN 'absent_conversation' WHEN m.turn = 99 THEN 'turn_out_of_range' WHEN m.turn = 4 THEN 'speaker_mismatch' ELSE 'ok' END AS state,
      CASE WHEN m.turn NOT IN (4, 99) AND m.conv_id < 100000 THEN md5(replace(trim(regexp_replace(s.text, '[ \t\n\r\f\v]+', ' ', 'g')), ' ,', ',')) END AS text_md5
    FROM m LEFT JOIN s USING (conv_id, turn) UNION ALL SELECT conv_id, turn, 'missing_label', NULL FROM s WHERE turn = 2""")
def reconstruct(t: Tables) -> DataFrame:
    src = W.source_turns(source_rows(t))
    base = src.select(F.lit("train").alias("split"), "conv_id", "turn", "speaker", F.lit("x").alias("label"), F.lit(3).alias("confidence"))
    meta = base.filter("turn <> 2").withColumn("speaker", F.when(F.col("turn") == 4, "Z").otherwise(F.col("speaker")))
    meta = meta.unionByName(base.filter("turn = 0").withColumns({"conv_id": F.col("conv_id") + 100000, "speaker": F.lit("A")}))
    meta = meta.unionByName(base.filter("turn = 1").withColumns({"turn": F.lit(99).cast("long"), "speaker": F.lit("A")}))
    good, rejects = W.reconstructed(meta, src)
    a = good.select("conv_id", "turn", F.lit("ok").alias("state"), F.md5("text").alias("text_md5"))
    return a.unionByName(rejects.select("conv_id", "turn", F.col("rule").alias("state"), F.lit(None).cast("string").alias("text_md5")))


@query("pending_S15", uses="responses", sql="""
    SELECT system, count(*) AS expected, count(*) FILTER (WHERE NOT (system = 'trim' AND turn = 3)) AS present, CASE WHEN system = 'echo' THEN count(*) FILTER (WHERE turn = 1) ELSE 0 END AS unexpected,
      CASE WHEN system = 'polite' THEN 0 ELSE 0 END::bigint AS duplicates, system = 'polite' AS complete, CASE WHEN system = 'trim' THEN count(*) FILTER (WHERE turn = 3) ELSE 0 END AS pending FROM responses GROUP BY system""")
def pending(t: Tables) -> DataFrame:
    want = t.responses.select("system", "example", "turn")
    extra = want.filter("system = 'echo' AND turn = 1").withColumn("example", F.concat("example", F.lit("x")))
    done = want.filter("NOT (system = 'trim' AND turn = 3)").unionByName(extra)
    state = resume.output_state(want, done, "system", "example")
    todo = resume.pending(want, done, ["system", "example"]).groupBy("system").agg(F.count(F.lit(1)).alias("pending"))
    return state.join(todo, "system", "left").fillna(0, ["pending"])


CLEAN = r"replace(trim(regexp_replace({}, '[ \t\n\r\f\v]+', ' ', 'g')), ' ,', ',')"


@query("evaluation_sources_S16", uses="turns", sql=f"""
    WITH h AS (SELECT b.conv_id, b.turn, {CLEAN.format("any_value(b.text)")} AS ref, count(*) AS n FROM turns b JOIN turns a ON a.conv_id = b.conv_id AND a.turn < b.turn WHERE b.role = 'B' GROUP BY b.conv_id, b.turn)
    SELECT source, turn + 1 AS turn, n AS history, md5(ref) AS reference_md5 FROM h CROSS JOIN (SELECT unnest([0, 1, 2]) AS source) WHERE source <> 1 OR n % 2 = 1""")
def evaluation_sources(t: Tables) -> DataFrame:
    situ = t.turns.withColumn("situation", F.lit("note"))
    turns = S.from_turn_rows(situ.select("conv_id", "turn", "role", "text", "situation"))
    h = seq.response_examples(t.turns, ["split", "conv_id"])
    one_line = F.transform("history", lambda x: F.regexp_replace(x["text"], "\\s+", " "))
    lists = S.from_context_lists(h.filter(F.size("history") % 2 == 1).select(
        F.lit(None).cast("string").alias("id"), F.lit("note").alias("situation"), one_line.alias("context"), F.col("reference").alias("target")))
    text = F.array_join(F.transform("history", lambda x: F.concat(x["role"], F.lit(": "), F.regexp_replace(x["text"], "\\s+", " "))), "\n")
    texts = S.from_context_texts(h.select("conv_id", "turn", F.lit("note").alias("situation"), text.alias("context"), F.col("reference").alias("response"), F.lit("B").alias("next_role")))
    e = S.evaluation_sources([turns, lists, texts])
    return e.select("source", "turn", F.size("history").cast("long").alias("history"), F.md5("reference").alias("reference_md5"))


@query("item_label_map_S17", uses="soft", sql="""
    WITH x AS (SELECT *, CASE WHEN label % 4 <> 0 THEN row_conf END AS c, CASE WHEN label % 3 <> 0 THEN support END AS n FROM soft),
    q AS (SELECT item, coalesce(CASE WHEN sum(CASE WHEN c IS NOT NULL THEN n END) > 0 THEN sum(c * n) / sum(CASE WHEN c IS NOT NULL THEN n END) END, avg(c) FILTER (WHERE n IS NULL)) AS mc FROM x GROUP BY item)
    SELECT item, label, round(p, 6) AS p, round(mc, 6) AS mean_conf FROM soft JOIN q USING (item)""")
def item_label_map(t: Tables) -> DataFrame:
    rows = t.soft.select("item", "label", (F.col("p") * 0.7).alias("soft_prob"), F.lit(None).cast("double").alias("item_conf"), F.when(F.col("label") % 4 != 0, F.col("row_conf")).alias("row_conf"),
                         F.when(F.col("label") % 3 != 0, F.col("support")).alias("support"))
    probs, conf = S.item_label_map(rows, ITEM)
    return probs.join(conf, "item").select("item", "label", r6("p"), r6("mean_conf"))


@query("region_labels_S18", uses="regional", sql="""
    SELECT item, round(sum(p), 6) AS mass, true AS mass_ok, CASE WHEN item LIKE '%|1' THEN 5 ELSE arg_min(region, (-round(p, 12), region)) END AS top1, round(-sum(p * ln(p)), 6) + 0.0 AS entropy, count(*) AS nonzero
    FROM regional GROUP BY item""")
def region_labels(t: Tables) -> DataFrame:
    rows = t.regional.withColumns({"top1": F.when(F.col("item").like("%|1"), F.lit(5).cast("long")), "entropy": F.lit(None).cast("double"), "nonzero": F.lit(None).cast("long")})
    r = S.region_labels(rows, ITEM)
    return r.select("item", r6("mass"), "mass_ok", "top1", r6("entropy"), "nonzero")


@query("lookups_S19", uses="turns", sql="""
    SELECT conv_id, turn, md5(text) AS text_md5, s.situation FROM turns LEFT JOIN (SELECT conv_id, md5(text) AS situation FROM conversations WHERE role = 'system') s USING (conv_id)""")
def lookups(t: Tables) -> DataFrame:
    rows = t.turns.select("conv_id", "turn", "text", F.lit(1).alias("ord"))
    rows = rows.unionByName(rows.withColumns({"text": F.lit("  "), "ord": F.lit(0)})).unionByName(rows.withColumns({"text": F.lit("later"), "ord": F.lit(2)}))
    texts = S.text_lookup(rows, ["conv_id", "turn"])
    c = t.read("conversations").select("conv_id", F.when(F.col("role") == "system", F.col("text")).alias("situation"), F.col("turn").alias("ord"))
    situ = S.situation_lookup(c, ["conv_id"])
    return texts.join(situ, "conv_id", "left").select("conv_id", "turn", F.md5("text").alias("text_md5"), F.md5("situation").alias("situation"))


@query("stored_similarity_S20", uses="label_vectors", sql="""
    SELECT a.label::varchar AS src, b.label::varchar AS dst, round(CASE WHEN a.label = b.label THEN 1 ELSE sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)) END, 6) AS w
    FROM label_vectors a JOIN label_vectors b USING (d) GROUP BY a.label, b.label""")
def stored_similarity(t: Tables) -> DataFrame:
    wide = W.wide_matrix(label_cosines(t), "src", "dst", "w", list(range(24)))
    return S.square_matrix(wide, "src").select("src", "dst", r6("w"))


@query("inventory_errors_S21", sql="""
    SELECT p_name AS key, 'duplicate_label' AS rule FROM part GROUP BY p_name HAVING count(*) > 1""")
def inventory_errors(t: Tables) -> DataFrame:
    return S.inventory_errors(t.read("part").select(F.col("p_name").alias("label")))


@query("annotator_errors_S21", uses="votes turns", sql="""
    WITH v AS (SELECT annotator, conv_id, turn, CASE WHEN turn = 3 AND annotator = 1 THEN NULL ELSE label END AS label, CASE WHEN turn = 5 AND annotator = 0 THEN 'e' END AS error FROM votes WHERE NOT (annotator = 2 AND turn = 4))
    SELECT annotator, conv_id, turn, 'duplicate_turn' AS rule FROM votes WHERE annotator = 3 AND turn = 0 UNION ALL SELECT annotator, conv_id, turn, 'missing_turn' FROM votes WHERE annotator = 2 AND turn = 4
    UNION ALL SELECT annotator, conv_id, turn, 'annotation_error' FROM v WHERE error IS NOT NULL UNION ALL SELECT annotator, conv_id, turn, 'empty_value' FROM v WHERE error IS NULL AND label IS NULL""")
def annotator_errors(t: Tables) -> DataFrame:
    v = t.votes.select("annotator", "conv_id", "turn", F.when(~((F.col("turn") == 3) & (F.col("annotator") == 1)), F.col("label")).alias("label"), "confidence",
                       F.when((F.col("turn") == 5) & (F.col("annotator") == 0), "e").alias("error"))
    v = v.filter("NOT (annotator = 2 AND turn = 4)")
    v = v.unionByName(v.filter("annotator = 3 AND turn = 0"))
    return S.annotator_errors(v, t.turns)
