"""Derived inputs: votes, membership and vectors computed from the driver tables.

Every table exists twice, as a DataFrame (class `Tables`) and as a SQL common table expression with the same
name (dict `CTES`), so a query and its SQL counterpart start from the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ranking
from ..functions.keys import hash60, item_key
from ..functions.lineage import checkpointed
from ..operators import membership as mem
from ..operators import sequence as seq
from ..operators import softlabel as sl

ANNOTATORS = 4
LABELS = 24
REGIONS = 6
ITEM = ["item"]


def r6(c: Column | str, name: str | None = None) -> Column:
    """Double rounded to 6 decimals, without a negative zero."""
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col.cast("double"), 6) + F.lit(0.0)
    return out.alias(name or (c if isinstance(c, str) else "value"))


# Stand-in inputs already written in this application, by (application, folder, table).
_STORED: dict[tuple[str, str, str], DataFrame] = {}


def stored(build):
    """A stand-in input table: derived from the driver tables once per application and kept as a checkpoint.

    In production these tables (turns, votes, predictions, responses) are files; queries start from them.
    """

    def get(self: Tables) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, build.__name__)
        if key not in _STORED:
            _STORED[key] = checkpointed(build(self))
        return _STORED[key]

    get.__doc__ = build.__doc__
    return property(get)


class Tables:
    """Driver tables of one scale and the tables derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def documents(self) -> DataFrame:
        """Texts, spread over all cores when the file has fewer splits than that (no change on large input)."""
        docs, cores = self.read("documents"), self.spark.sparkContext.defaultParallelism
        return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs

    @stored
    def turns(self) -> DataFrame:
        spoken = self.read("conversations").filter(F.col("role").isin("user", "assistant"))
        numbered = ranking.positions(
            spoken.withColumnRenamed("turn", "raw_turn"), ["conv_id"], ["raw_turn"],
            F.floor(F.col("raw_turn") / ranking.BLOCK), "turn",
        )
        bucket = hash60(F.col("conv_id")) % 10
        split = F.when(bucket <= 6, "train").when(bucket <= 8, "valid").otherwise("test")
        return numbered.select(
            item_key(split, F.col("conv_id"), F.col("turn")).alias("item"),
            split.alias("split"),
            "conv_id",
            "turn",
            F.when(F.col("role") == "user", "A").otherwise("B").alias("role"),
            "text",
        )

    @stored
    def votes(self) -> DataFrame:
        ann = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ANNOTATORS - 1).cast("long"))).alias("annotator")
        rows = self.turns.select("item", "split", "conv_id", "turn", "role", ann)
        hb = hash60(F.col("conv_id"), F.col("turn"))
        ha = hash60(F.col("conv_id"), F.col("turn"), F.col("annotator"))
        hc = hash60(F.col("conv_id"), F.col("turn"), F.col("annotator"), F.lit("c"))
        hashed = rows.withColumns({"_hb": hb, "_ha": ha, "_hc": hc})
        return hashed.select(
            *rows.columns,
            F.expr(f"(CASE WHEN _ha % 10 < 6 THEN _hb ELSE _ha div 10 END) % {LABELS}").alias("label"),
            (1 + F.col("_hc") % 5).alias("confidence"),
        )

    @stored
    def membership(self) -> DataFrame:
        label = self.spark.range(LABELS).select(F.col("id").alias("label"))
        l = F.col("label")
        primary = F.struct((l % REGIONS).alias("region"), F.when(l % 3 == 0, 1.0).otherwise(0.75).alias("m"))
        second = F.struct(
            ((l + 1 + F.floor(l / REGIONS)) % REGIONS).cast("long").alias("region"),
            F.when(l % 3 == 0, 0.0).otherwise(0.25).alias("m"),
        )
        rows = label.select("label", F.explode(F.array(primary, second)).alias("x")).select("label", "x.*")
        return rows.filter("m > 0").groupBy("label", "region").agg(F.sum("m").alias("m"))

    @cached_property
    def soft(self) -> DataFrame:
        return sl.soft_labels(self.votes, ITEM)

    @cached_property
    def item_conf(self) -> DataFrame:
        return self.votes.groupBy("item").agg(F.avg("confidence").alias("mean_conf"))

    @cached_property
    def regional(self) -> DataFrame:
        """Sparse region distribution per item: item, region, p."""
        return mem.project(self.soft, self.membership, ITEM)

    @cached_property
    def dist(self) -> DataFrame:
        """Dense region distribution per item: item, dist array, with turn columns."""
        # Nine decimals before the final normalisation, so that tied regions are tied in every engine.
        d = mem.dense_regions(self.regional, ITEM, REGIONS).withColumn("_d", F.transform("dist", lambda x: F.round(x, 9)))
        d = d.withColumn("_t", F.aggregate("_d", F.lit(0.0), lambda s, x: s + x))
        d = d.select("item", F.transform("_d", lambda x: x / F.col("_t")).alias("dist"))
        return self.turns.join(d, "item").join(self.item_conf, "item")

    @stored
    def label_vectors(self) -> DataFrame:
        """label, v array of 4: derived from the labels that occur in the votes."""
        seen = self.votes.select("label").distinct()
        part = lambda d: (hash60(F.lit("v"), F.col("label"), F.lit(d)) % 1000).cast("double") / 1000.0 - 0.5
        return seen.select("label", F.array(*[part(d) for d in range(4)]).alias("v"))

    @stored
    def preds(self) -> DataFrame:
        """A soft prediction for every item: gold mixed with hashed noise.  item, split, role, gold, pred."""
        d = self.dist.withColumnRenamed("dist", "gold")
        noise = lambda j: (hash60(F.lit("n"), F.col("item"), F.lit(j)) % 100).cast("double") / 200.0
        raw = F.array(*[F.lit(0.05) + F.element_at("gold", j + 1) * 0.6 + noise(j) for j in range(REGIONS)])
        total = F.aggregate("_raw", F.lit(0.0), lambda s, x: s + x)
        return (
            d.withColumn("_raw", raw)
            .withColumn("pred", F.transform("_raw", lambda x: x / total))
            .select("item", "split", "conv_id", "turn", "role", "mean_conf", "gold", "pred")
        )

    @cached_property
    def pairs(self) -> DataFrame:
        """Typed lag-1 and lag-2 pairs of items."""
        return seq.typed_pairs(self.turns, ["split", "conv_id"], "turn", ["item", "role"])

    @stored
    def examples(self) -> DataFrame:
        """Response examples: each B turn that has a previous turn, with that turn as context."""
        nxt = ranking.ahead(self.turns, ["split", "conv_id"], "turn", ["item", "turn", "role", "text"], (1,))
        return nxt.filter("next1.role = 'B'").select(
            F.col("next1.item").alias("example"), "split", "conv_id",
            F.col("next1.turn").alias("turn"), F.col("text").alias("context"), F.col("next1.text").alias("reference"),
        )

    @stored
    def responses(self) -> DataFrame:
        """Three derived systems: `echo` repeats the context, `trim` drops short words, `polite` adds a phrase."""
        words = F.regexp_extract_all(F.lower("reference"), F.lit("([a-z0-9']+)"), F.lit(1))
        trim = F.array_join(F.filter(words, lambda x: F.length(x) > 2), " ")
        options = F.array(
            F.struct(F.lit("echo").alias("system"), F.col("context").alias("response")),
            F.struct(F.lit("trim").alias("system"), trim.alias("response")),
            F.struct(
                F.lit("polite").alias("system"), F.concat(F.lit("I understand. "), trim, F.lit(".")).alias("response")
            ),
        )
        return self.examples.select("*", F.explode(options).alias("o")).select(
            "o.system", "example", "split", "conv_id", "turn", "context", "reference", "o.response"
        )


# Shared SQL: name -> (names it needs, body).
CTES: dict[str, tuple[str, str]] = {
    "turns": ("", """
        SELECT concat_ws('|', split, conv_id, turn) AS item, split, conv_id, turn, role, text FROM (
          SELECT conv_id, text, CASE WHEN role = 'user' THEN 'A' ELSE 'B' END AS role,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn,
            CASE WHEN ('0x'||substr(md5(conv_id::varchar),1,15))::bigint % 10 <= 6 THEN 'train'
                 WHEN ('0x'||substr(md5(conv_id::varchar),1,15))::bigint % 10 <= 8 THEN 'valid' ELSE 'test' END AS split
          FROM conversations WHERE role IN ('user', 'assistant'))"""),
    "votes": ("turns", f"""
        SELECT item, split, conv_id, turn, role, annotator,
          (CASE WHEN ha % 10 < 6 THEN hb ELSE ha // 10 END) % {LABELS} AS label, 1 + hc % 5 AS confidence
        FROM (SELECT t.*, a.annotator,
            ('0x'||substr(md5(concat_ws('|', conv_id, turn)),1,15))::bigint AS hb,
            ('0x'||substr(md5(concat_ws('|', conv_id, turn, annotator)),1,15))::bigint AS ha,
            ('0x'||substr(md5(concat_ws('|', conv_id, turn, annotator, 'c')),1,15))::bigint AS hc
          FROM turns t CROSS JOIN (SELECT unnest(range(0, {ANNOTATORS})) AS annotator) a)"""),
    "membership": ("", f"""
        SELECT label, region, sum(m) AS m FROM (
          SELECT l AS label, l % {REGIONS} AS region, CASE WHEN l % 3 = 0 THEN 1.0::double ELSE 0.75::double END AS m
          FROM range(0, {LABELS}) t(l)
          UNION ALL
          SELECT l, (l + 1 + l // {REGIONS}) % {REGIONS}, 0.25::double FROM range(0, {LABELS}) t(l) WHERE l % 3 <> 0)
        GROUP BY ALL"""),
    "soft": ("votes", """
        SELECT item, label, mass, support, row_conf, mass / sum(mass) OVER (PARTITION BY item) AS p FROM (
          SELECT item, label, sum(confidence)::double AS mass, count(*) AS support, avg(confidence) AS row_conf
          FROM votes GROUP BY item, label)"""),
    "item_conf": ("votes", "SELECT item, avg(confidence) AS mean_conf FROM votes GROUP BY item"),
    "regional": ("soft membership", """
        SELECT item, region, sum(p * m) AS p FROM soft JOIN membership USING (label) GROUP BY item, region
        HAVING sum(p * m) > 1e-12"""),
    "dist": ("turns regional item_conf", f"""
        SELECT * EXCLUDE (q), q / sum(q) OVER (PARTITION BY item) AS p FROM (
        SELECT t.*, r.region, round(coalesce(x.p, 0.0), 9) AS q, c.mean_conf FROM turns t
        CROSS JOIN (SELECT unnest(range(0, {REGIONS})) AS region) r
        LEFT JOIN regional x ON x.item = t.item AND x.region = r.region JOIN item_conf c ON c.item = t.item)"""),
    "label_vectors": ("votes", """
        SELECT label, d, (('0x'||substr(md5(concat_ws('|', 'v', label, d)),1,15))::bigint % 1000)::double / 1000 - 0.5 AS x
        FROM (SELECT DISTINCT label FROM votes) CROSS JOIN (SELECT unnest(range(0, 4)) AS d)"""),
    "preds": ("dist", """
        SELECT item, split, conv_id, turn, role, mean_conf, region, gold, raw / sum(raw) OVER (PARTITION BY item) AS pred
        FROM (SELECT *, p AS gold,
            0.05::double + p * 0.6::double
            + (('0x'||substr(md5(concat_ws('|', 'n', item, region)),1,15))::bigint % 100)::double / 200 AS raw
          FROM dist)"""),
    "pairs": ("turns", """
        SELECT split, conv_id, pair, s_item, t_item, lag FROM (
          SELECT split, conv_id, role || '2' || lead(role, 1) OVER w AS pair, item AS s_item,
            lead(item, 1) OVER w AS t_item, 1 AS lag FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
          UNION ALL
          SELECT split, conv_id, role || '2' || lead(role, 2) OVER w, item, lead(item, 2) OVER w, 2
          FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        WHERE (lag = 1 AND pair IN ('A2B', 'B2A')) OR (lag = 2 AND pair IN ('A2A', 'B2B'))"""),
    "examples": ("turns", """
        SELECT b.item AS example, b.split, b.conv_id, b.turn, a.text AS context, b.text AS reference
        FROM turns b JOIN turns a ON a.conv_id = b.conv_id AND a.turn = b.turn - 1 WHERE b.role = 'B'"""),
    "responses": ("examples", """
        SELECT s.system, e.*, CASE s.system WHEN 'echo' THEN context WHEN 'trim' THEN trimmed
            ELSE 'I understand. ' || trimmed || '.' END AS response
        FROM (SELECT *, array_to_string(list_filter(regexp_extract_all(lower(reference), '[a-z0-9'']+'),
                lambda x: length(x) > 2), ' ') AS trimmed FROM examples) e
        CROSS JOIN (SELECT unnest(['echo', 'trim', 'polite']) AS system) s"""),
}


def with_ctes(uses: str, body: str) -> str:
    """Prefix `body` with the named shared tables and everything they need, in dependency order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in CTES[name][0].split():
            visit(dep)
        ordered.append(name)

    for name in uses.split():
        visit(name)
    # Materialised, so that a table used several times is computed once.
    parts = ", ".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in ordered)
    text = body.strip()
    if not parts:
        return text
    if text[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {parts}, {text[15:]}"
    return f"WITH {parts}, {text[5:]}" if text[:5].upper() == "WITH " else f"WITH {parts} {text}"
