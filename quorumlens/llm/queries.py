"""The registered queries: each operator over its whole table, with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


# Without vectored reads a column of a row group is read in pieces; a vectored read keeps a buffer of its whole length outside the heap, in each of its threads.
PIECES = {"parquet.hadoop.vectored.io.enabled": False}


def table(spark: SparkSession, sf_dir: str, name: str, **options: bool) -> DataFrame:
    return spark.read.options(**options).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


SUBSTRING_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
places AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words WHERE len(w) >= 20)),
marked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1 AS again FROM places),
gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i, unnest(range(20)) AS k FROM marked WHERE again)),
lost AS (SELECT doc_id, count(*) AS n, list(i) AS spots FROM gone GROUP BY doc_id)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
  sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ')
    ELSE array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(spots, i)), lambda i: w[i]), ' ') END) AS kept_sha256
FROM words LEFT JOIN lost ON lost.doc_id = words.doc_id
"""


@query("op8_substring_dedup", SUBSTRING_SQL)
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import drop_repeats

    found = drop_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


@query("op2_near_duplicates")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, class_id (its least doc_id), class_size, n_texts (different texts in the class)."""
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


DECONTAMINATION_SQL = r"""
WITH RECURSIVE low AS (
  SELECT 'd' AS kind, CAST(doc_id AS VARCHAR) AS id, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
  UNION ALL
  SELECT 'b', coalesce(CAST(item_id AS VARCHAR), ''), NULL,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
words AS (
  SELECT kind, id, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
asked AS (
  SELECT DISTINCT id, len(part) AS n, array_to_string(part, ' ') AS phrase
  FROM (SELECT id, w[i:i + least(13, len(w)) - 1] AS part
        FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM words WHERE kind = 'b' AND len(w) > 0))),
lengths AS (SELECT DISTINCT n FROM asked),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, lengths WHERE kind = 'd' AND len(w) >= n)),
found AS (SELECT doc_id, i, places.n, id FROM places JOIN asked ON asked.phrase = places.phrase AND asked.n = places.n),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (
  SELECT DISTINCT doc_id, i + k FROM (SELECT doc_id, i, unnest(range(n)) AS k FROM found) AS x(doc_id, i, k)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, id FROM found) GROUP BY doc_id)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit ON hit.doc_id = words.doc_id LEFT JOIN items ON items.doc_id = words.doc_id
WHERE kind = 'd'
"""


@query("op1_benchmark_decontamination", DECONTAMINATION_SQL)
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination, is_contaminated

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


@query("op6_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each piece; the tokens can't be made in SQL."""
    from .pack import pack
    from .tokens import VOCABULARY

    return pack(table(spark, sf_dir, "documents"), VOCABULARY)


@query("op5_jump_sharding")
def jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document; DuckDB has neither crc32 nor the hash of the keys."""
    from .shard import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), 8)


@query("op10_string_kernel_language")
def string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, sf_dir, "documents")).drop("text_key")


@query("op7_projected_neighbours")
def projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth vector; approximate, so the test compares with brute force."""
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


@query("op3_line_dedup")
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, the removed runs of lines, and the SHA-256 of the text that is left."""
    from .linededup import drop_repeated_lines

    found = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split("text", "\n")).alias("n_lines")))
    return found.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), "n_removed", F.array_join(
        F.transform("runs", lambda r: F.concat_ws("-", r["start"], r["end"])), ",").alias("runs"),
        F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


@query("op4_attention_scores")
def attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score_documents

    return score_documents(table(spark, sf_dir, "documents", **PIECES))


@query("op9_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: paragraphs, confirmed licences, their families and the paragraphs they stand in."""
    from .license import scan

    found = scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_paragraphs", F.size("licences").cast("long").alias("n_licences"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("licences", lambda x: x["family"]))), ",").alias("families"),
        F.array_join(F.transform("licences", lambda x: x["paragraph"].cast("string")), ",").alias("paragraphs"))


# Unsigned CRC-32 (IEEE) of the ASCII text `s`, for use in SQL that has a table crc_table(t).
CRC_TABLE = """crc_table AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
  lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) x(i)))"""


def crc_sql(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c // 256, t[CAST(xor(c % 256, b) AS INT) + 1])), 4294967295)"


def _merkle_leaf(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({x}) || ':' || {x}, '-')" for x in fields) + ")"


MANIFEST_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
leaves AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce('=' || source, '-') AS part, {_merkle_leaf("text")} AS leaf,
    CASE WHEN {crc_sql("CAST(doc_id AS VARCHAR)")} % 5 = 0
      THEN {_merkle_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed
  FROM documents, crc_table),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
nodes AS (
  SELECT part, 0 AS level, place AS idx, leaf AS h FROM placed
  UNION ALL
  SELECT part, level + 1, idx // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM (
    SELECT *, count(*) OVER (PARTITION BY part) AS n FROM nodes) WHERE n > 1 GROUP BY part, level, idx // 16),
tops AS MATERIALIZED (SELECT part, max(level) AS height, arg_max(h, level) AS subroot FROM nodes GROUP BY part),
ordered AS (SELECT part, height, subroot, row_number() OVER (ORDER BY part) - 1 AS place FROM tops),
upper AS (
  SELECT 0 AS level, place AS idx, subroot AS h FROM ordered
  UNION ALL
  SELECT level + 1, idx // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER () AS n FROM upper) WHERE n > 1 GROUP BY level, idx // 16),
summit AS (SELECT max(level) AS top, arg_max(h, level) AS root FROM upper),
beside AS MATERIALIZED (
  SELECT part, level, idx, coalesce(string_agg(h, '') OVER (PARTITION BY part, level, idx // 16 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER (PARTITION BY part, level, idx // 16 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM (SELECT nodes.* FROM nodes JOIN tops USING (part) WHERE level < height
    UNION ALL SELECT '', level, idx, h FROM upper, summit WHERE level < top)),
steps AS (
  SELECT id, level AS k, l, r FROM placed JOIN tops USING (part) JOIN beside b ON b.part = placed.part AND b.level < height AND b.idx = place // CAST(pow(16, b.level) AS BIGINT)
  UNION ALL
  SELECT id, height + level, l, r FROM placed JOIN ordered o USING (part) JOIN beside b ON b.part = '' AND b.idx = o.place // CAST(pow(16, b.level) AS BIGINT)),
walks AS (SELECT id, list(l || '|' || r ORDER BY k) AS walk, string_agg(l || r, '' ORDER BY k) AS proof FROM steps GROUP BY id),
done AS (
  SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce(list_prepend(coalesce(changed, leaf), coalesce(walk, [])), lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) AS folded_root
  FROM placed JOIN ordered USING (part) LEFT JOIN walks USING (id), summit)
SELECT *, folded_root = root AS verified FROM done
"""


@query("op13_merkle_manifest", MANIFEST_SQL)
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of the documents, and whether each still leads to the root after every fifth was tampered with."""
    from .merkle import verify

    return verify(table(spark, sf_dir, "documents"), F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0)


# Edits of the role grammar by automaton: states 0 start, 1 after system, 2 after user, 3 after assistant.
REPAIR_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc_sql("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS kind
  FROM conversations, crc_table),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM base WHERE kind <> 0)),
placed AS MATERIALIZED (
  SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS conv, *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt),
numbered AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS again,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final FROM placed),
judged AS MATERIALIZED (
  SELECT *, left(role, 1) AS initial, CASE WHEN final = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'fine' END AS fault FROM numbered),
inserts(p, q, pre, cost, lines) AS (VALUES (0, 0, '', 0, ''), (1, 1, '', 0, ''), (2, 2, '', 0, ''), (3, 3, '', 0, ''), (0, 2, 'I', 3, 'user:
'), (1, 2, 'I', 3, 'user:
'),
  (2, 3, 'I', 3, 'assistant:
'), (3, 2, 'I', 3, 'user:
'), (0, 3, 'II', 6, 'user:
assistant:
'), (1, 3, 'II', 6, 'user:
assistant:
')),
edits(q, s, own, edit, cost, role) AS (VALUES (0, 0, '*', 'D', 4, NULL), (1, 1, '*', 'D', 4, NULL), (2, 2, '*', 'D', 4, NULL), (3, 3, '*', 'D', 4, NULL),
  (0, 1, 's', 'K', 0, '='), (0, 2, 'u', 'K', 0, '='), (1, 2, 'u', 'K', 0, '='), (3, 2, 'u', 'K', 0, '='), (2, 3, 'a', 'K', 0, '='),
  (0, 2, '*', 'R', 3, 'user'), (1, 2, '*', 'R', 3, 'user'), (3, 2, '*', 'R', 3, 'user'), (2, 3, '*', 'R', 3, 'assistant')),
ways AS MATERIALIZED (SELECT p, s, own, pre || edit AS edit, i.cost + e.cost AS cost, lines, role FROM inserts i JOIN edits e USING (q)),
walk AS (
  SELECT DISTINCT conv, CAST(0 AS BIGINT) AS i, 0 AS s, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'body': ''}} AS best FROM judged
  UNION ALL
  SELECT w.conv, j.i, y.s, min({{'cost': w.best.cost + y.cost + CASE WHEN j.fault = 'truncated' AND y.role IS NOT NULL THEN 3 ELSE 0 END, 'audit': w.best.audit || y.edit,
    'body': w.best.body || y.lines || CASE y.role WHEN '=' THEN j.role || ':' || j.text || chr(10) ELSE coalesce(y.role || ':' || j.text || chr(10), '') END}})
  FROM walk w JOIN judged j ON j.conv = w.conv AND j.i = w.i + 1 JOIN ways y ON y.p = w.s
    AND y.own IN ('*', j.initial) AND (y.role IS NULL OR j.fault NOT IN ('blank', 'duplicate'))
  GROUP BY w.conv, j.i, y.s),
ended AS (
  SELECT conv, min({{'cost': best.cost + n.cost, 'audit': best.audit || n.pre, 'body': best.body || n.lines}}) AS best
  FROM walk w JOIN (SELECT conv, max(i) AS i FROM judged GROUP BY conv) USING (conv, i) JOIN inserts n ON n.p = w.s AND n.q IN (0, 3) GROUP BY conv),
counted AS (
  SELECT conv, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(initial) OVER (PARTITION BY conv ORDER BY i) AS before FROM judged) GROUP BY conv)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(best.body[:-2], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended ON ended.conv = c.conv
"""


@query("op12_conversation_repair", REPAIR_SQL)
def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every conversation after every row was damaged as its checksum says."""
    from .turns import damaged, repair

    return repair(damaged(table(spark, sf_dir, "conversations")))


@query("op11_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document; a fitted model is not SQL, so tests measure held-out documents."""
    from .fm import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
