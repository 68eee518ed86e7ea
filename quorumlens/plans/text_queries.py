"""Queries for keys and text columns (X) and generated-text metrics (E)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import ranking
from ..functions import text as X
from ..operators import textmetrics as TM
from .fixtures import CTES, Tables, r6
from .registry import query

TOKS = "regexp_extract_all(lower({}), '[a-z0-9'']+')"
CTES.update({
    "resp_toks": ("responses", f"""
        SELECT system || '|' || example AS rid, system, example, split, response, reference, context,
          {TOKS.format('response')} AS h, {TOKS.format('reference')} AS r, {TOKS.format('context')} AS c FROM responses"""),
    "resp_grams": ("resp_toks", """
        SELECT rid, n, gram, sum(hc)::bigint AS hc, sum(rc)::bigint AS rc FROM (
          SELECT rid, n, array_to_string(h[i:i+n-1], ' ') AS gram, 1 AS hc, 0 AS rc
          FROM (SELECT rid, h, n, unnest(range(1, len(h) - n + 2)) AS i FROM resp_toks, (SELECT unnest([1,2,3,4]) AS n))
          UNION ALL
          SELECT rid, n, array_to_string(r[i:i+n-1], ' '), 0, 1
          FROM (SELECT rid, r, n, unnest(range(1, len(r) - n + 2)) AS i FROM resp_toks, (SELECT unnest([1,2,3,4]) AS n)))
        GROUP BY rid, n, gram"""),
    "resp_stats": ("resp_grams resp_toks", """
        SELECT t.rid, """ + ", ".join(
        f"coalesce(sum(least(hc, rc)) FILTER (n = {n}), 0) AS o{n}, coalesce(sum(hc) FILTER (n = {n}), 0) AS h{n}, "
        f"coalesce(sum(rc) FILTER (n = {n}), 0) AS r{n}" for n in (1, 2, 3, 4)) + """
        FROM resp_toks t LEFT JOIN resp_grams g ON g.rid = t.rid GROUP BY t.rid"""),
})


def bleu_sql(upto: int) -> str:
    logs = " + ".join(f"ln(greatest(CASE WHEN h{n} > 0 THEN o{n} / h{n} ELSE 0 END, 1e-9))" for n in range(1, upto + 1))
    return (f"CASE WHEN h1 > 0 THEN (CASE WHEN h1 > r1 THEN 1.0 ELSE exp(1 - r1 / h1) END) * exp(({logs}) / {upto}) ELSE 0.0 END")


def f1_sql(n: int) -> str:
    return f"CASE WHEN o{n} > 0 THEN 2 * (o{n} / h{n}) * (o{n} / r{n}) / (o{n} / h{n} + o{n} / r{n}) ELSE 0.0 END"


METEOR_SQL = "CASE WHEN o1 > 0 THEN 10 * (o1 / h1) * (o1 / r1) / (o1 / r1 + 9 * (o1 / h1)) ELSE 0.0 END"
SMOOTH_SQL = ("CASE WHEN h1 > 0 AND r1 > 0 THEN (CASE WHEN h1 > r1 THEN 1.0 ELSE exp(1 - r1 / h1) END) * exp(("
              + " + ".join(f"ln(CASE WHEN h{n} = 0 THEN 1.0 ELSE (o{n} + 1) / (h{n} + 1) END)" for n in (1, 2, 3, 4))
              + ") / 4) ELSE 0.0 END")


# ---- keys (X1-X4, X15, X18-X20) --------------------------------------------------------------------------

@query("canonical_keys_X1_X2_X3", sql="""
    SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'dev' ELSE 'train' END AS split,
      CASE role WHEN 'user' THEN 'A' WHEN 'assistant' THEN 'B' ELSE CASE WHEN turn % 2 = 0 THEN 'A' ELSE 'B' END END AS side,
      CASE WHEN conv_id % 3 = 0 THEN 'dev' ELSE 'train' END || '|' || conv_id || '|' || turn AS item,
      CASE WHEN role = 'user' THEN 'A2B' WHEN role = 'assistant' THEN 'B2B' END AS pair
    FROM conversations""")
def canonical_keys(t: Tables) -> DataFrame:
    split = K.canonical_split(F.when(F.col("conv_id") % 3 == 0, F.lit(" Valid ")).otherwise(F.lit("TRAIN")))
    side = K.canonical_role(F.col("role"), F.col("turn"))
    letter = F.when(F.col("role") == "user", "a").when(F.col("role") == "assistant", " b").otherwise("x")
    return t.read("conversations").select(
        "conv_id", "turn", split.alias("split"), side.alias("side"),
        K.item_key(split, F.col("conv_id"), F.col("turn")).alias("item"),
        K.role_pair(letter, F.lit("b")).alias("pair"),
    )


@query("order_key_X4", sql="""
    SELECT p_partkey, row_number() OVER (ORDER BY num NULLS LAST, txt) AS rank FROM (
      SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_partkey::varchar || '.7' WHEN 1 THEN 'turn ' || p_partkey
        WHEN 2 THEN p_partkey::varchar ELSE 'none ' || translate(p_partkey::varchar, '0123456789', 'abcdefghij') END AS txt,
        CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE p_partkey END AS num FROM part)""")
def order_key(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    txt = (
        F.when(k % 4 == 0, F.concat(k.cast("string"), F.lit(".7"))).when(k % 4 == 1, F.concat(F.lit("turn "), k.cast("string")))
        .when(k % 4 == 2, k.cast("string"))
        .otherwise(F.concat(F.lit("none "), F.translate(k.cast("string"), "0123456789", "abcdefghij")))
    )
    rows = t.read("part").select("p_partkey", txt.alias("txt"))
    keyed = rows.withColumn("ok", K.order_key(F.col("txt")))
    block = F.floor(F.least(F.col("ok.number"), F.lit(1e15)) / 512)
    ranked = ranking.positions(keyed, [], ["ok"], block)
    return ranked.select("p_partkey", (F.col("pos") + 1).alias("rank"))


@query("confidence_bin_X15", sql="""
    SELECT bin, count(*) AS n FROM (SELECT CASE WHEN l_linenumber = 7 THEN 'missing' WHEN l_linenumber = 6 THEN '4-5'
      WHEN l_quantity::bigint % 6 <= 2 THEN '1-2' WHEN l_quantity::bigint % 6 = 3 THEN '3' ELSE '4-5' END AS bin FROM lineitem) GROUP BY bin""")
def confidence_bin(t: Tables) -> DataFrame:
    raw = F.when(F.col("l_linenumber") == 7, F.lit("n/a")).when(F.col("l_linenumber") == 6, F.lit("4-5")).otherwise(
        (F.col("l_quantity").cast("long") % 6).cast("string"))
    return t.read("lineitem").select(X.confidence_bin(raw).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query("stable_id_X18", sql="""
    SELECT doc_id, 'ed_' || substr(sha1(lang || chr(10) || source || chr(10) || text), 1, 16) AS stable_id, sha256(text) AS text_hash
    FROM documents""")
def stable_id(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", K.stable_id("ed", F.col("lang"), F.col("source"), F.col("text")).alias("stable_id"),
        F.sha2("text", 256).alias("text_hash"))


@query("first_filled_X19_X20", sql="""
    SELECT event_id, coalesce(nullif(trim(CASE WHEN event_id % 3 = 0 THEN '  ' ELSE NULL END), ''),
        CASE WHEN event_id % 3 = 1 THEN event_type END, 'k' || (props::json->>'k')) AS picked,
      CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS number, CASE WHEN event_id % 5 = 0 THEN NULL ELSE trunc(value)::bigint END AS whole,
      CASE WHEN event_id % 4 = 0 THEN true WHEN event_id % 4 = 1 THEN false END AS flag
    FROM events""")
def first_filled(t: Tables) -> DataFrame:
    e = F.col("event_id")
    number = F.when(e % 5 == 0, F.lit("NaN")).otherwise(F.col("value").cast("string"))
    flag = F.when(e % 4 == 0, " Yes").when(e % 4 == 1, "FALSE").otherwise("maybe")
    return t.read("events").select(
        "event_id",
        K.first_filled(F.when(e % 3 == 0, F.lit("  ")), F.when(e % 3 == 1, F.col("event_type")),
                       F.concat(F.lit("k"), F.get_json_object("props", "$.k"))).alias("picked"),
        K.finite_double(number).alias("number"), K.int_via_double(number).alias("whole"), K.tolerant_bool(flag).alias("flag"),
    )


# ---- text columns ----------------------------------------------------------------------------------------

CLEAN_SQL = r"replace(trim(regexp_replace(replace({}, '_comma_', ','), '[ \t\n\r\f\v]+', ' ', 'g')), ' ,', ',')"
MATCH_SQL = "trim(regexp_replace(lower(" + CLEAN_SQL + "), '[^a-z0-9'']+', ' ', 'g'))"


@query("clean_text_X5_X6", sql=f"""
    SELECT doc_id, md5({CLEAN_SQL.format("text")}) AS clean_md5, md5({MATCH_SQL.format("text")}) AS match_md5 FROM documents""")
def clean_text(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", F.md5(X.clean(F.col("text"))).alias("clean_md5"), F.md5(X.match_text(F.col("text"))).alias("match_md5"))


@query("content_key_X6", uses="turns", sql=f"""
    SELECT b.item, sha256(concat_ws(chr(1), 'situ', string_agg({MATCH_SQL.format("a.text")}, chr(2) ORDER BY a.turn),
      any_value({MATCH_SQL.format("b.text")}))) AS content_key
    FROM turns b JOIN turns a ON a.conv_id = b.conv_id AND a.turn < b.turn WHERE b.role = 'B' GROUP BY b.item""")
def content_key(t: Tables) -> DataFrame:
    from ..operators import sequence as seq

    e = seq.response_examples(t.turns, ["split", "conv_id"])
    return e.select("item", X.content_key(F.lit(" Situ!"), F.col("history"), F.col("reference")).alias("content_key"))


@query("tokens_X7", sql=f"""
    SELECT doc_id, len(h) AS words, CASE WHEN len(h) < 2 THEN 0 ELSE len(h) - 1 END AS bigrams, len(list_distinct(h)) AS vocabulary,
      len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS spaced
    FROM (SELECT doc_id, text, {TOKS.format("text")} AS h FROM documents)""")
def tokens(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", X.words_by_space(F.col("text")).alias("spaced"), X.tokens(F.col("text")).alias("h"))
    return d.select("doc_id", F.size("h").cast("long").alias("words"), F.size(X.bigrams(F.col("h"))).cast("long").alias("bigrams"),
                    F.size(F.array_distinct("h")).cast("long").alias("vocabulary"), "spaced")


@query("clean_prediction_X8", uses="turns", sql=f"""
    SELECT item, md5(trim({CLEAN_SQL.format("text")}, '"')) AS prediction_md5 FROM turns""")
def clean_prediction(t: Tables) -> DataFrame:
    head = F.when(F.col("turn") % 3 == 0, "Response: B:  ").when(F.col("turn") % 3 == 1, '"').otherwise(" reply:A: ")
    return t.turns.select("item", F.md5(X.clean_prediction(F.concat(head, "text"))).alias("prediction_md5"))


@query("clean_response_X8", uses="turns", sql=f"""
    SELECT item, md5(trim(trim(CASE WHEN turn % 3 = 2 THEN 'reply:A: ' ELSE '' END || {CLEAN_SQL.format("text")}, '"'))) AS response_md5 FROM turns""")
def clean_response(t: Tables) -> DataFrame:
    head = F.when(F.col("turn") % 3 == 0, "Response: B:  ").when(F.col("turn") % 3 == 1, '"').otherwise(" reply:A: ")
    return t.turns.select("item", F.md5(X.clean_response(F.concat(head, "text"))).alias("response_md5"))


@query("clean_evaluation_X8", uses="turns", sql="""
    SELECT item, md5(trim(CASE WHEN contains(text, chr(10)) THEN text ELSE text END, E' \\n')) AS evaluation_md5 FROM turns""")
def clean_evaluation(t: Tables) -> DataFrame:
    tail = F.when(F.col("turn") % 2 == 0, "\nContext: more").otherwise(" (12 Words)")
    raw = F.concat(F.lit("Rewritten reply: Reply: "), "text", tail)
    return t.turns.select("item", F.md5(X.clean_evaluation(raw)).alias("evaluation_md5"))


@query("question_flag_X9", sql=f"""
    SELECT doc_id, contains(text, '?') OR contains(text, '？') OR regexp_matches(text,
      '(?i)^[\\s"''“”‘’(\\[]*(?:{"|".join(X.QUESTION_WORDS)})\\b') AS is_question FROM documents""")
def question_flag(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.is_question(F.col("text")).alias("is_question"))


def any_regex(col: str, patterns: list[str]) -> str:
    return "(" + " OR ".join("regexp_matches({}, '{}')".format(col, p.replace("'", "''")) for p in patterns) + ")"


def in_list(col: str, values: list[str]) -> str:
    return f"{col} IN (" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


NORM_SQL = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"
EXACT_SQL = "regexp_replace({}, '[.!?]+$', '')"
FLAG_TEXT = """CASE doc_id % 6 WHEN 0 THEN 'I''m sorry to hear that!' WHEN 1 THEN 'That sounds ' || text WHEN 2 THEN 'yeah '
    || substring(source, 1, 30) || ' i hope it goes' ELSE text END"""


def flag_docs(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 6
    txt = (
        F.when(k == 0, F.lit("I'm sorry to hear that!")).when(k == 1, F.concat(F.lit("That sounds "), "text"))
        .when(k == 2, F.concat(F.lit("yeah "), F.substring("source", 1, 30), F.lit(" i hope it goes"))).otherwise(F.col("text"))
    )
    return t.documents.select("doc_id", txt.alias("text"))


@query("generic_flags_X10", sql=f"""
    SELECT doc_id, n > 0 AND ({in_list(EXACT_SQL.format("cl"), X.GENERIC_A_EXACT)} OR n <= 4 OR (n <= 24 AND
        {any_regex("cl", X.GENERIC_A_PATTERNS)})) AS generic_a,
      {in_list(EXACT_SQL.format("nm"), X.GENERIC_B_EXACT)} OR (w <= 20 AND {any_regex("nm", X.GENERIC_B_PATTERNS)}) AS generic_b,
      {" OR ".join("contains(cl, '" + p.replace("'", "''") + "')" for p in X.GENERIC_C_PHRASES)} AS generic_c,
      {" OR ".join("starts_with(nm, '" + p.replace("'", "''") + "')" for p in X.GENERIC_D_STARTS)} AS generic_d
    FROM (SELECT doc_id, lower({CLEAN_SQL.format("text")}) AS cl, {NORM_SQL.format("text")} AS nm, len({TOKS.format("text")}) AS n,
        len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS w
      FROM (SELECT doc_id, {FLAG_TEXT} AS text FROM documents))""")
def generic_flags(t: Tables) -> DataFrame:
    d = flag_docs(t).withColumn("toks", X.tokens(F.col("text")))
    c = F.col("text")
    return d.select("doc_id", X.generic_rules_a(c, F.col("toks")).alias("generic_a"), X.generic_rules_b(c).alias("generic_b"),
                    X.generic_rules_c(c).alias("generic_c"), X.generic_rules_d(c).alias("generic_d"))


GRAM_LISTS_SQL = """
    list_transform(range(1, len(h)), lambda i: h[i] || ' ' || h[i+1]) AS bi,
    list_transform(range(1, len(h) - 1), lambda i: h[i] || ' ' || h[i+1] || ' ' || h[i+2]) AS tri"""


@query("repetition_X11", sql=f"""
    SELECT doc_id, list_bool_or(list_transform(range(1, len(h) - 1), lambda i: h[i] = h[i+1] AND h[i+1] = h[i+2])) IS TRUE
        OR len(tri) > len(list_distinct(tri)) OR len(s) > len(list_distinct(s)) AS repeated_a,
      round(CASE WHEN len(bi) + len(tri) > 0 THEN (len(bi) - len(list_distinct(bi)) + len(tri) - len(list_distinct(tri)))
        / (len(bi) + len(tri)) ELSE 0 END, 6) AS share_b,
      round(CASE WHEN len(h) > 0 THEN (len(h) - len(list_distinct(h))) / len(h) ELSE 0 END, 6) AS rate_c,
      coalesce(list_max(map_values(list_histogram(h))), 0) >= 3
        OR list_bool_or(list_transform(range(1, len(h)), lambda i: h[i] = h[i+1])) IS TRUE AS repeated_d
    FROM (SELECT doc_id, h, {GRAM_LISTS_SQL}, list_filter(list_transform(string_split_regex(text, '[.!?]+'),
        lambda x: trim(regexp_replace(lower(x), '[^a-z0-9'']+', ' ', 'g'))), lambda x: x <> '') AS s
      FROM (SELECT doc_id, text, {TOKS.format("text")} AS h FROM documents))""")
def repetition(t: Tables) -> DataFrame:
    d = TM.text_columns(t.documents.select("doc_id", "text"), "text")
    toks, bi, tri = F.col("toks"), F.col("bi"), F.col("tri")
    return d.select("doc_id", X.repetition_rules_a(F.col("text"), toks, tri).alias("repeated_a"),
                    r6(X.repetition_share(bi, tri), "share_b"), r6(X.duplicate_rate(toks), "rate_c"),
                    X.repetition_rules_d(toks).alias("repeated_d"))


@query("leak_flags_X12", uses="responses", sql=f"""
    SELECT system, example, turn % 4 = 0 AS leak, turn % 8 = 4 AS multi, round(CASE WHEN len(h) > 0 THEN len(list_intersect(h, c)) / len(list_distinct(h))
      ELSE 0 END, 6) AS copy_share, {MATCH_SQL.format("response")} <> '' AND {MATCH_SQL.format("response")} = {MATCH_SQL.format("context")} AS exact_copy
    FROM (SELECT *, {TOKS.format("response")} AS h, {TOKS.format("context")} AS c FROM responses)""".replace(
        "turn % 4 = 0 AS leak, turn % 8 = 4 AS multi", "turn % 4 IN (1, 3) AS leak, turn % 4 = 3 AS multi"))
def leak_flags(t: Tables) -> DataFrame:
    r = TM.text_columns(t.responses, "response", "context")
    lead = F.when(F.col("turn") % 4 == 1, "x\nSpeaker :").when(F.col("turn") % 4 == 3, "B: y\n listener:\n User:").otherwise("")
    marked = F.concat(lead, "response")
    return r.select("system", "example", X.role_leak(marked).alias("leak"), X.multi_turn_leak(marked).alias("multi"),
                    r6(X.copy_share(F.col("toks"), F.col("ctx_toks")), "copy_share"),
                    X.exact_copy(F.col("response"), F.col("context")).alias("exact_copy"))


STRIP_SQL = """list_distinct(list_filter(list_transform(string_split_regex({}, '\\s+'), lambda w:
    lower(trim(w, '.,!?;:''"()[]{{}} '))), lambda w: w <> ''))"""


@query("set_overlap_X13", uses="responses", sql=f"""
    SELECT system, example, round(CASE WHEN len(list_distinct(h || r)) > 0 THEN len(list_intersect(h, r)) / len(list_distinct(h || r)) ELSE 0 END, 6) AS jaccard,
      round(CASE WHEN len(r) > 0 THEN len(list_intersect(h, r)) / len(list_distinct(r)) ELSE 0 END, 6) AS recall,
      round(CASE WHEN len(list_distinct(a || b)) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(a || b)) ELSE 1 END, 6) AS stripped
    FROM (SELECT *, {TOKS.format("response")} AS h, {TOKS.format("reference")} AS r, {STRIP_SQL.format("response")} AS a,
      {STRIP_SQL.format("reference")} AS b FROM responses)""")
def set_overlap(t: Tables) -> DataFrame:
    r = TM.text_columns(t.responses, "response", reference="reference")
    a, b = X.stripped_words(F.col("response")), X.stripped_words(F.col("reference"))
    r = r.withColumns({"a": a, "b": b})
    return r.select("system", "example", r6(X.jaccard(F.col("toks"), F.col("ref_toks")), "jaccard"),
                    r6(X.recall_overlap(F.col("toks"), F.col("ref_toks")), "recall"),
                    r6(X.jaccard(F.col("a"), F.col("b"), 1.0), "stripped"))


@query("length_flags_X14", uses="responses", sql="""
    SELECT system, example, w < 18 AS too_short, w > 32 AS too_long, w BETWEEN 18 AND 32 AS length_ok,
      regexp_matches(response, '[.!?]["'')\\]]*\\s*$') AS complete
    FROM (SELECT *, len(list_filter(string_split_regex(response, '\\s+'), lambda x: x <> '')) AS w FROM responses)""")
def length_flags(t: Tables) -> DataFrame:
    r = t.responses.withColumn("w", X.words_by_space(F.col("response")))
    flags = X.length_flags(F.col("w"))
    return r.select("system", "example", *[c.alias(n) for n, c in flags.items()], X.complete_sentence(F.col("response")).alias("complete"))


@query("history_text_X17", uses="turns", sql=f"""
    SELECT conv_id, count(*) AS turns, md5(string_agg(role || ': ' || {CLEAN_SQL.format("text")}, chr(10) ORDER BY turn)) AS serialized_md5,
      md5('Situation:' || chr(10) || 'note' || chr(10) || chr(10) || 'Dialogue history:' || chr(10) || chr(10)
        || string_agg(role || ': ' || {CLEAN_SQL.format("text")}, chr(10) ORDER BY turn) || chr(10) || chr(10) || 'Next speaker: B') AS input_md5
    FROM turns WHERE trim({CLEAN_SQL.format("text")}) <> '' GROUP BY conv_id""")
def history_text(t: Tables) -> DataFrame:
    # The conversation as one text is the input form of this parser; one row per conversation.
    one = F.struct("turn", F.concat(F.when(F.col("role") == "A", "Speaker: ").otherwise("assistant :"), F.regexp_replace("text", "\n+", " ")).alias("l"))
    texts = t.turns.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["l"]), " <SEP> ").alias("h"))
    parsed = texts.withColumn("p", X.parse_history(F.col("h"))).withColumn("s", X.serialize_history(F.col("p")))
    return parsed.select("conv_id", F.size("p").cast("long").alias("turns"), F.md5("s").alias("serialized_md5"),
                         F.md5(X.input_text(F.lit("note"), F.col("s"), F.lit("B"))).alias("input_md5"))


# ---- generated text --------------------------------------------------------------------------------------

def scored(t: Tables) -> DataFrame:
    rid = F.concat("system", F.lit("|"), "example")
    return t.responses.withColumn("rid", rid)


@query("bleu_E1_E2", uses="resp_stats", sql=f"""
    SELECT rid, {", ".join(f"round({bleu_sql(n)}, 6) AS bleu_{n}" for n in (1, 2, 3, 4))}, round({SMOOTH_SQL}, 6) AS bleu_smooth FROM resp_stats""")
def bleu(t: Tables) -> DataFrame:
    s = TM.gram_stats(scored(t), "rid", "response", "reference")
    return s.select("rid", *[r6(TM.bleu_floored(n), f"bleu_{n}") for n in (1, 2, 3, 4)], r6(TM.bleu_smoothed(), "bleu_smooth"))


@query("rouge_meteor_E3_E5", uses="resp_stats", sql=f"""
    SELECT rid, round({f1_sql(1)}, 6) AS rouge_1, round({f1_sql(2)}, 6) AS rouge_2, round({METEOR_SQL}, 6) AS meteor FROM resp_stats""")
def rouge_meteor(t: Tables) -> DataFrame:
    s = TM.gram_stats(scored(t), "rid", "response", "reference", 2)
    return s.select("rid", r6(TM.rouge_n(1), "rouge_1"), r6(TM.rouge_n(2), "rouge_2"), r6(TM.meteor_unigram(), "meteor"))


@query("rouge_l_E4")
def rouge_l(t: Tables) -> DataFrame:
    return TM.with_rouge_l(scored(t), "response", "reference").select("rid", r6("rouge_l"))


def distinct_sql(n: int, table: str, key: str, toks: str) -> str:
    return f"""SELECT {key}, count(DISTINCT g) / count(*) AS d FROM (SELECT {key}, unnest(list_transform(range(1, len({toks}) - {n} + 2),
      lambda i: array_to_string({toks}[i:i+{n}-1], ' '))) AS g FROM {table}) GROUP BY {key}"""


@query("distinct_n_E6", sql=f"""
    WITH d AS (SELECT lang, {TOKS.format("text")} AS h FROM documents)
    SELECT lang, round(a.d, 6) AS distinct_1, round(b.d, 6) AS distinct_2 FROM ({distinct_sql(1, "d", "lang", "h")}) a
    JOIN ({distinct_sql(2, "d", "lang", "h")}) b USING (lang)""")
def distinct_n(t: Tables) -> DataFrame:
    d = t.documents.select("lang", "text")
    both = TM.distinct_n(d, ["lang"], "text", 1).join(TM.distinct_n(d, ["lang"], "text", 2), "lang")
    return both.select("lang", r6("distinct_1"), r6("distinct_2"))


SELF_SQL = """
    p AS (SELECT * FROM resp_toks),
    g AS (SELECT rid, system, n, gram, count(*) AS c FROM (SELECT rid, system, n, array_to_string(h[i:i+n-1], ' ') AS gram
      FROM (SELECT rid, system, h, n, unnest(range(1, len(h) - n + 2)) AS i FROM p, (SELECT unnest(range(1, {upto} + 1)) AS n))) GROUP BY ALL),
    o AS (SELECT *, coalesce(CASE WHEN row_number() OVER w = 1 THEN nth_value(c, 2) OVER f ELSE first_value(c) OVER f END, 0) AS other FROM g
      WINDOW w AS (PARTITION BY system, n, gram ORDER BY c DESC, rid),
        f AS (PARTITION BY system, n, gram ORDER BY c DESC, rid ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    st AS (SELECT rid, n, sum(least(c, other)) AS ov, sum(c) AS t FROM o GROUP BY ALL),
    r AS (SELECT a.rid, a.system, len(a.h) AS h1, (SELECT len(b.h) FROM p b WHERE b.system = a.system AND b.rid <> a.rid {filled}
        ORDER BY abs(len(b.h) - len(a.h)), len(b.h) LIMIT 1) AS r1 FROM p a)"""


@query("self_bleu_E7", uses="resp_toks", sql=f"""
    WITH {SELF_SQL.format(upto=2, filled="")}
    SELECT system, round(avg(CASE WHEN h1 = 0 OR r1 IS NULL THEN 0.0 ELSE (CASE WHEN h1 > r1 THEN 1.0 ELSE exp(1 - r1 / h1) END)
      * exp((SELECT sum(ln(greatest(coalesce(ov / t, 0), 1e-9))) / 2 FROM (SELECT unnest([1, 2]) AS n) q
        LEFT JOIN st ON st.rid = r.rid AND st.n = q.n)) END), 6) AS self_bleu FROM r GROUP BY system""")
def self_bleu(t: Tables) -> DataFrame:
    return TM.self_bleu(scored(t), ["system"], "rid", "response", None, 2, False).select("system", r6("self_bleu"))


@query("self_bleu_smoothed_E7", uses="resp_toks", sql=f"""
    WITH {SELF_SQL.format(upto=4, filled="AND len(b.h) > 0")}
    SELECT system, round(avg(CASE WHEN h1 = 0 OR r1 IS NULL THEN 0.0 ELSE (CASE WHEN h1 > r1 THEN 1.0 ELSE exp(1 - r1 / h1) END)
      * exp((SELECT sum(ln(CASE WHEN t IS NULL THEN 1.0 ELSE (ov + 1) / (t + 1) END)) / 4 FROM (SELECT unnest([1, 2, 3, 4]) AS n) q
        LEFT JOIN st ON st.rid = r.rid AND st.n = q.n)) END), 6) AS self_bleu FROM r GROUP BY system""")
def self_bleu_smoothed(t: Tables) -> DataFrame:
    return TM.self_bleu(scored(t), ["system"], "rid", "response", None, 4, True).select("system", r6("self_bleu"))


BLOCK_SQL = """avg(len(h)) AS mean_words"""


@query("quality_block_E8", uses="resp_toks", sql=f"""
    WITH x AS (SELECT *, {GRAM_LISTS_SQL} FROM resp_toks), d1 AS ({distinct_sql(1, "resp_toks", "system", "h")}),
    d2 AS ({distinct_sql(2, "resp_toks", "system", "h")})
    SELECT system, count(*) AS n, round(avg(len(h)), 6) AS mean_words, round(stddev_pop(len(h)), 6) AS std_words,
      round(avg(length(response)), 6) AS mean_chars, round(avg((len(h) = 0)::int), 6) AS empty_rate,
      round(avg(CASE WHEN len(bi) > 0 THEN (len(bi) - len(list_distinct(bi))) / len(bi) ELSE 0 END), 6) AS repeat_bigram,
      round(avg(CASE WHEN len(list_distinct(h || r)) > 0 THEN len(list_intersect(h, r)) / len(list_distinct(h || r)) ELSE 0 END), 6) AS ref_overlap,
      round(avg(CASE WHEN len(c) > 0 THEN len(list_intersect(h, c)) / len(list_distinct(c)) ELSE 0 END), 6) AS ctx_recall,
      round(any_value(d1.d), 6) AS distinct_1, round(any_value(d2.d), 6) AS distinct_2
    FROM x JOIN d1 USING (system) JOIN d2 USING (system) GROUP BY system""")
def quality_block(t: Tables) -> DataFrame:
    b = TM.quality_block(t.responses, ["system"], "response", "reference", "context")
    return b.select("system", "n", *[r6(c) for c in ("mean_words", "std_words", "mean_chars", "empty_rate", "repeat_bigram",
                                                     "ref_overlap", "ctx_recall", "distinct_1", "distinct_2")])


@query("diagnostics_E9", sql=f"""
    WITH x AS (SELECT lang, text, {TOKS.format("text")} AS h FROM documents), d1 AS ({distinct_sql(1, "x", "lang", "h")})
    SELECT lang, round(avg(len(h)), 6) AS mean_length, round(avg((len(h) < 3)::int), 6) AS too_short_rate,
      round(avg((coalesce(list_max(map_values(list_histogram(h))), 0) >= 3 OR list_bool_or(list_transform(range(1, len(h)),
        lambda i: h[i] = h[i+1])) IS TRUE)::int), 6) AS repetition_rate, round(any_value(d1.d), 6) AS distinct_1
    FROM x JOIN d1 USING (lang) GROUP BY lang""")
def diagnostics(t: Tables) -> DataFrame:
    d = TM.diagnostics(t.documents.select("lang", "text"), ["lang"], "text")
    return d.select("lang", r6("mean_length"), r6("too_short_rate"), r6("repetition_rate"), r6("distinct_1"))


def per_example_rows(t: Tables) -> DataFrame:
    return TM.per_example(scored(t), "rid", "response", "reference", "context")


@query("per_example_E10", uses="resp_stats resp_toks", sql=f"""
    SELECT rid, len(h) AS words, round({bleu_sql(2)}, 6) AS bleu_2, round({bleu_sql(4)}, 6) AS bleu_4, round({f1_sql(1)}, 6) AS rouge_1,
      round({METEOR_SQL}, 6) AS meteor, len(h) = 0 AS empty, len(h) BETWEEN 1 AND 2 AS too_short,
      {" OR ".join("contains(lower(" + CLEAN_SQL.format("response") + "), '" + p.replace("'", "''") + "')" for p in X.GENERIC_C_PHRASES)} AS generic,
      round(CASE WHEN len(h) > 0 THEN len(list_intersect(h, c)) / len(list_distinct(h)) ELSE 0 END, 6) AS copy_share
    FROM resp_toks JOIN resp_stats USING (rid)""")
def per_example(t: Tables) -> DataFrame:
    e = per_example_rows(t)
    return e.select("rid", "words", r6("bleu_2"), r6("bleu_4"), r6("rouge_1"), r6("meteor"), "empty", "too_short", "generic", r6("copy_share"))


@query("per_system_E11", uses="resp_stats resp_toks", sql=f"""
    WITH d2 AS ({distinct_sql(2, "resp_toks", "system", "h")})
    SELECT system, count(*) AS n, round(avg({bleu_sql(4)}), 6) AS bleu_4, round(avg({f1_sql(2)}), 6) AS rouge_2, round(avg({METEOR_SQL}), 6) AS meteor,
      round(count(DISTINCT {MATCH_SQL.format("response")}) / count(*), 6) AS unique_responses,
      round(count(DISTINCT CASE WHEN len(h) > 0 THEN array_to_string(h[1:3], ' ') END) / count(*) FILTER (WHERE len(h) > 0), 6) AS unique_starts,
      count(*) - count(DISTINCT example) AS duplicate_ids, min(len(h)) AS min_words, max(len(h)) AS max_words, round(any_value(d2.d), 6) AS distinct_2
    FROM resp_toks JOIN resp_stats USING (rid) JOIN d2 USING (system) GROUP BY system""")
def per_system(t: Tables) -> DataFrame:
    rows = scored(t)
    s = TM.per_system(rows, per_example_rows(t), "system", "response", "example")
    return s.select("system", "n", r6("bleu_4"), r6("rouge_2"), r6("meteor"), r6("unique_responses"), r6("unique_starts"),
                    "duplicate_ids", "min_words", "max_words", r6("distinct_2"))
