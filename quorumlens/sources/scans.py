"""Readers: files to typed DataFrames, and the flattening that follows.

Each reader has two halves: `read_*` names the files and the format, the other function reshapes the rows and
works on any DataFrame of that shape.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.keys import canonical_role, canonical_split, finite_double, item_key, small_side, stable_id
from . import splits

# Aliases of columns, and keys that may wrap a list of records.
CONVERSATION_IDS = ["dialogue_id", "dialog_id", "conv_id", "conversation_id", "id"]
SITUATIONS = ["situation", "prompt", "scenario"]
LABEL_KEYS = ["selected_emoji", "emoji", "label", "prediction", "pred_emoji"]
CONFIDENCE_KEYS = ["confidence", "conf", "score", "prob"]
TURN_KEYS = ["turn_id", "turn", "utterance_idx", "utt_id", "index"]
ROLE_KEYS = ["speaker", "role", "speaker_id"]
TEXT_KEYS = ["utterance", "text", "sentence", "content"]
WRAPPERS = ["records", "data", "utterances", "annotations", "nodes", "emojis", "items", "clusters"]
VECTOR_KEYS = ["shrunk_centroid_json", "local_vector_json", "vector", "embedding", "z", "raw_centroid_json", "global_vector_json"]

_ANN = ", ".join(f"{k}: string" for k in [*LABEL_KEYS, *CONFIDENCE_KEYS, "unicode", "error"])
_TURN = ", ".join(f"{k}: string" for k in [*TURN_KEYS, *ROLE_KEYS, *TEXT_KEYS])
NESTED_SCHEMA = (
    ", ".join(f"{k} string" for k in [*CONVERSATION_IDS, *SITUATIONS, "split", "dataset_split"])
    + f", turns array<struct<{_TURN}, emoji_annotation: struct<{_ANN}>, annotation: struct<{_ANN}>>>"
)


def first_of(prefix: str, names: Sequence[str]) -> Column:
    """First alias that is neither null nor NaN."""
    cols = [F.col(f"{prefix}{n}") for n in names]
    return F.coalesce(*[F.when(F.lower(c) != "nan", c) for c in cols])


def _file_columns(df: DataFrame) -> DataFrame:
    path = F.col("_file")
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    split = F.when(name.rlike("^(valid|dev)"), "dev").when(name.rlike("^test"), "test").otherwise("train")
    return df.withColumns({"_annotator": F.element_at(F.split(path, "/"), -2), "_split": split})


def read_dialogues(spark: SparkSession, path: str, pattern: str = "*.json", recursive: bool = False) -> DataFrame:
    """JSON arrays of conversations.  One DataFrame for all files, large ones read by many tasks; the annotator is
    the parent folder and the split comes from the file name."""
    return _file_columns(splits.read_json(spark, path, NESTED_SCHEMA, pathGlobFilter=pattern, recursiveFileLookup=str(recursive).lower()))


def read_annotations(spark: SparkSession, root: str) -> DataFrame:
    """S3: every `*_emoji_annotations.json` below the root."""
    return read_dialogues(spark, root, "*_emoji_annotations.json", recursive=True)


def flatten_dialogues(df: DataFrame) -> DataFrame:
    """One row per (annotator, conversation, turn); `df` has the nested schema plus _annotator and _split."""
    conv = first_of("", CONVERSATION_IDS)
    split = canonical_split(F.coalesce(first_of("", ["split", "dataset_split"]), F.col("_split")))
    rows = df.select(
        conv.alias("conv_id"), split.alias("split"), F.coalesce(first_of("", SITUATIONS), F.lit("")).alias("situation"),
        F.col("_annotator").alias("annotator"), F.posexplode("turns").alias("_i", "t"))
    pick = lambda names: F.coalesce(first_of("t.emoji_annotation.", names), first_of("t.annotation.", names))
    conf = F.coalesce(finite_double(F.nullif(pick(CONFIDENCE_KEYS), F.lit(""))), F.lit(1.0))
    turn = F.coalesce(first_of("t.", TURN_KEYS).try_cast("long"), F.col("_i").cast("long"))
    return rows.select(
        "conv_id", turn.alias("turn"), "split", canonical_role(first_of("t.", ROLE_KEYS), F.col("_i")).alias("role"),
        F.coalesce(first_of("t.", TEXT_KEYS), F.lit("")).alias("text"), "situation", "annotator",
        F.trim(F.coalesce(pick(LABEL_KEYS), F.lit(""))).alias("label"), conf.alias("confidence"))


VOTE_SCHEMA = "dialogue_id string, turn_id long, split string, role string, text string, model string, emoji string, confidence double"


def read_votes(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """Flat votes from json (optionally wrapped under a known key), jsonl, csv or parquet."""
    if fmt == "parquet":
        rows = spark.read.parquet(path)
    elif fmt == "csv":
        rows = splits.read_csv(spark, path, VOTE_SCHEMA)
    elif fmt == "jsonl":
        rows = spark.read.schema(VOTE_SCHEMA).json(path)
    elif fmt == "json":
        fields = ", ".join(f.replace(" ", ": ", 1) for f in VOTE_SCHEMA.split(", "))
        wrapped = ", ".join(f"{w} array<struct<{fields}>>" for w in WRAPPERS)
        names = [f.split(" ")[0] for f in VOTE_SCHEMA.split(", ")]

        def single(paths: list[str]) -> DataFrame:
            raw = spark.read.schema(f"{VOTE_SCHEMA}, {wrapped}").option("multiLine", True).json(paths).withColumn("_file", F.col("_metadata.file_path"))
            return raw.select(F.inline(F.coalesce(*[F.col(w) for w in WRAPPERS], F.array(F.struct(*names)))), "_file")

        rows = splits.read_json(spark, path, VOTE_SCHEMA, WRAPPERS, single)
    else:
        raise ValueError(f"unknown format {fmt}")
    return as_votes(rows)


def as_votes(rows: DataFrame) -> DataFrame:
    """Vote columns under this library's names."""
    return rows.select(
        F.col("dialogue_id").cast("string").alias("conv_id"), F.col("turn_id").cast("long").alias("turn"), canonical_split(F.col("split")).alias("split"),
        canonical_role(F.col("role"), F.col("turn_id")).alias("role"), "text", F.col("model").alias("annotator"), F.col("emoji").alias("label"),
        F.col("confidence").cast("double").alias("confidence"))


def from_model_maps(rows: DataFrame) -> DataFrame:
    """Rows with models[], label map and confidence map to votes; empty maps or lists yield nothing."""
    usable = rows.filter((F.size("models") > 0) & (F.size(F.map_keys("model_emojis")) > 0))
    m = usable.select(*[c for c in rows.columns if c not in ("models", "model_emojis", "model_confidences")],
                      F.explode("models").alias("annotator"), "model_emojis", "model_confidences")
    return m.withColumns({"label": F.try_element_at("model_emojis", F.col("annotator")), "confidence": F.try_element_at("model_confidences", F.col("annotator")).cast("double")}
                         ).drop("model_emojis", "model_confidences").filter("label is not null")


def from_turn_maps(dialogues: DataFrame) -> DataFrame:
    """Conversations whose turns carry annotator -> label and annotator -> confidence maps."""
    t = dialogues.select("conv_id", "split", F.posexplode("turns").alias("turn", "t"))
    e = t.select("conv_id", "split", F.col("turn").cast("long").alias("turn"), "t.role", "t.text", F.explode("t.emoji").alias("annotator", "label"), F.col("t.confidence").alias("_c"))
    return e.withColumn("confidence", F.try_element_at("_c", F.col("annotator")).cast("double")).drop("_c").filter("label is not null")


def merged_single_annotator(votes: DataFrame, file_order: str = "ord") -> DataFrame:
    """Label and confidence maps per turn from single-annotator rows; the later file wins per annotator.

    Two aggregates: the winner per (turn, annotator) first, then one map entry per annotator.
    """
    keys = ["split", "conv_id", "turn"]
    last = votes.filter("label is not null").groupBy(*keys, "annotator").agg(F.max_by(F.struct("label", "confidence"), file_order).alias("v"))
    return last.groupBy(*keys).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("annotator", "v.label")))).alias("labels"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("annotator", "v.confidence")))).alias("confidences"))


def soft_label_table(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored long table (label, soft_prob, mean_confidence, support) regrouped by item: mass renormalised, entropy
    (bits) and top label recomputed, item confidence weighted by support or, without any support, by probability."""
    p = finite_double(F.col("soft_prob"))
    base = rows.withColumns({"p": p, "c": finite_double(F.col("mean_confidence")), "n": finite_double(F.col("support"))}).filter("p > 0")
    item = Window.partitionBy(*keys)  # one row per label of an item
    share = base.withColumn("p", F.col("p") / F.sum("p").over(item))
    agg = share.groupBy(*keys).agg(
        (-F.sum(F.col("p") * F.log2("p"))).alias("entropy_bits"), F.count(F.lit(1)).alias("nonzero"),
        F.min(F.struct((-F.round("p", 12)).alias("a"), F.col("label").alias("b")))["b"].alias("top_label"), F.max("p").alias("top_p"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("c") * F.col("n"))).alias("_cn"), F.sum(F.when(F.col("c").isNotNull(), F.col("n"))).alias("_n"),
        F.sum(F.col("c") * F.col("p")).alias("_cp"), F.sum(F.when(F.col("c").isNotNull(), F.col("p"))).alias("_p"))
    conf = F.when(F.col("_n") > 0, F.col("_cn") / F.col("_n")).when(F.col("_p") > 0, F.col("_cp") / F.col("_p"))
    return agg.select(*keys, "entropy_bits", "nonzero", "top_label", "top_p", conf.alias("mean_conf"))


def membership(rows: DataFrame, column: str = "membership_raw", fallback: str = "membership_prob", label: str = "label") -> DataFrame:
    """(label, region, m): requested column or the fallback, values at or below 0 dropped, duplicates summed."""
    cols = [finite_double(F.col(c)) for c in (column, fallback) if c in rows.columns]
    m = rows.select(label, "region", F.coalesce(*cols).alias("m")).filter((F.col("m") > 0) & F.col(label).isNotNull() & F.col("region").isNotNull())
    return m.groupBy(label, "region").agg(F.sum("m").alias("m"))


def lenient_membership(rows: DataFrame, column: str = "m", label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Dense label x region grid with rows rescaled to 1; the second result lists values below -1e-12 and
    labels without mass.  Labels and regions are the bounded dimensions."""
    bad = rows.filter(F.col(column) < -1e-12).select(label, "region", F.lit("negative").alias("rule"))
    m = rows.groupBy(label, "region").agg(F.max(F.greatest(F.col(column), F.lit(0.0))).alias("m"))
    total = m.withColumn("_t", F.sum("m").over(Window.partitionBy(label)))
    empty = total.filter("_t <= 0").select(label, F.lit(None).cast(rows.schema["region"].dataType).alias("region"), F.lit("no_mass").alias("rule")).distinct()
    grid = m.select(label).distinct().join(small_side(m.select("region").distinct(), 10_000), F.lit(True))  # regions: a checked handful
    full = grid.join(total.select(label, "region", "m"), [label, "region"], "left").fillna(0.0, ["m"])
    share = F.sum("m").over(Window.partitionBy(label))
    return full.withColumn("_s", share).filter("_s > 0").select(label, "region", (F.col("m") / F.col("_s")).alias("m")), bad.unionByName(empty)


def region_number(c: Column) -> Column:
    """Integer region id found in a text such as `cluster_03`."""
    return F.regexp_extract(c.cast("string"), r"-?\d+", 0).try_cast("long")


def stance_space(supports: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """Label rows with the membership array over the sorted regions and a vector of common length.

    supports: (label, region, support) from `long_supports`, `wide_supports` or `nested_supports`.  A label without
    a stored vector gets its membership row, padded or cut to the length of the stored ones.
    """
    clean = supports.filter("label <> '' AND region IS NOT NULL").groupBy("label", "region").agg(F.sum(F.greatest(F.col("support"), F.lit(0.0))).alias("s"))
    regions = clean.agg(F.sort_array(F.collect_set("region")).alias("_regions"))  # a handful
    per = clean.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("region", "s"))).alias("_m"), F.sum("s").alias("_t"))
    j = per.crossJoin(F.broadcast(regions))  # one-row side
    share = F.transform("_regions", lambda r: F.coalesce(F.try_element_at("_m", r), F.lit(0.0)) / F.when(F.col("_t") > 0, F.col("_t")).otherwise(1.0))
    out = j.select("label", F.col("_regions").alias("regions"), share.alias("membership"))
    if vectors is None:
        return out.withColumn("vector", F.col("membership"))
    dim = vectors.agg(F.max(F.size("v")).alias("_d"))
    k = out.join(small_side(vectors.select("label", "v")), "label", "left").crossJoin(F.broadcast(dim))  # one-row side
    padded = F.slice(F.concat("membership", F.array_repeat(F.lit(0.0), F.greatest(F.col("_d") - F.size("membership"), F.lit(0)))), F.lit(1), F.col("_d"))
    return k.withColumn("vector", F.coalesce("v", padded)).drop("v", "_d")


def long_supports(rows: DataFrame) -> DataFrame:
    return rows.select("label", region_number(F.col("cluster_id")).alias("region"), finite_double(F.col("membership_raw")).alias("support"))


def wide_supports(rows: DataFrame, prefix: str = "raw_cluster_") -> DataFrame:
    cols = [c for c in rows.columns if c.startswith(prefix)]
    typed = rows.select("label", *[F.coalesce(finite_double(F.col(c)), F.lit(0.0)).alias(c) for c in cols])
    return typed.unpivot(["label"], cols, "name", "support").select("label", region_number(F.col("name")).alias("region"), "support")


def nested_supports(rows: DataFrame) -> DataFrame:
    """Rows with `cluster` and `candidateClusters` (array of cluster, support)."""
    own = F.array(F.struct(region_number(F.col("cluster")).alias("region"), F.lit(1.0).alias("support")))
    others = F.transform(F.coalesce("candidateClusters", F.array()), lambda c: F.struct(region_number(c["cluster"]).alias("region"), c["support"].cast("double").alias("support")))
    return rows.select("label", F.inline(F.concat(own, others)))


def vector_column(rows: DataFrame, key: Sequence[str], json_col: str) -> tuple[DataFrame, DataFrame]:
    """JSON text to array<double>; the second result lists rows whose length differs from the most common one
    or that cannot be parsed."""
    v = rows.select(*key, F.from_json(F.col(json_col), "array<double>").alias("v"))
    lengths = v.filter("v is not null").groupBy(F.size("v").alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    usual = lengths.agg(F.max_by("_l", F.struct("_n", "_l")).alias("_u"))
    j = v.crossJoin(F.broadcast(usual))  # one-row side
    good = F.col("v").isNotNull() & (F.size("v") == F.col("_u"))
    return j.filter(good).select(*key, "v"), j.filter(~good | F.col("v").isNull()).select(*key, F.size("v").alias("length"))


def vectors_by_priority(rows: DataFrame, key: str, priority: Sequence[str] = tuple(VECTOR_KEYS)) -> DataFrame:
    """First parseable vector column in priority order."""
    present = [c for c in priority if c in rows.columns]
    as_array = lambda c: F.from_json(F.col(c), "array<double>") if dict(rows.dtypes)[c] == "string" else F.col(c).cast("array<double>")
    return rows.select(key, F.coalesce(*[as_array(c) for c in present]).alias("v")).filter("v is not null")


def square_matrix(wide: DataFrame, key: str) -> DataFrame:
    """Square label matrix (header labels) to long pairs (src, dst, w)."""
    cols = [c for c in wide.columns if c != key]
    return wide.select(F.col(key).cast("string").alias("src"), *[F.col(c).cast("double") for c in cols]).unpivot(["src"], cols, "dst", "w")


def item_label_map(rows: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(item, label, p) with duplicates summed and renormalised, and (item, mean_conf): the direct value, else
    the support-weighted mean of the row values, else their plain mean.

    rows: keys, label, soft_prob, item_conf, row_conf, support.
    """
    p = finite_double(F.col("soft_prob"))
    probs = rows.filter((p > 0) & F.col("label").isNotNull()).groupBy(*keys, "label").agg(F.sum(p).alias("p"))
    probs = probs.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy(*keys)))  # labels of one item
    c, n, d = finite_double(F.col("row_conf")), finite_double(F.col("support")), finite_double(F.col("item_conf"))
    weighted = F.when(n > 0, n)
    conf = rows.groupBy(*keys).agg(
        F.max(d).alias("_d"), F.sum(c * weighted).alias("_cn"), F.sum(F.when(c.isNotNull(), weighted)).alias("_n"), F.avg(F.when(n.isNull() | (n <= 0), c)).alias("_c"))
    return probs, conf.select(*keys, F.coalesce("_d", F.when(F.col("_n") > 0, F.col("_cn") / F.col("_n")), "_c").alias("mean_conf"))


def region_labels(rows: DataFrame, keys: Sequence[str], tol: float = 1e-8) -> DataFrame:
    """Long (item, region, p) with item columns filled where absent: top region, entropy (nats), nonzero count,
    and a mass flag.  rows may carry stored top1, entropy, nonzero."""
    agg = rows.filter("p > 0").groupBy(*keys).agg(
        F.sum("p").alias("mass"), (-F.sum(F.col("p") * F.ln("p"))).alias("_h"), F.count(F.lit(1)).alias("_k"),
        F.min(F.struct((-F.round("p", 12)).alias("a"), F.col("region").alias("b")))["b"].alias("_t"),
        F.max("top1").alias("top1"), F.max("entropy").alias("entropy"), F.max("nonzero").alias("nonzero"))
    return agg.select(*keys, "mass", (F.abs(F.col("mass") - 1) <= tol).alias("mass_ok"), F.coalesce("top1", "_t").alias("top1"),
                      F.coalesce("entropy", "_h").alias("entropy"), F.coalesce("nonzero", "_k").alias("nonzero"))


def text_lookup(rows: DataFrame, keys: Sequence[str], order: str = "ord") -> DataFrame:
    """One text per turn: the first non-empty one wins, else empty."""
    filled = F.trim(F.coalesce("text", F.lit(""))) != ""
    return rows.groupBy(*keys).agg(F.max_by(F.coalesce("text", F.lit("")), F.struct(filled, -F.col(order))).alias("text"))


def situation_lookup(rows: DataFrame, keys: Sequence[str], order: str = "ord") -> DataFrame:
    """One non-empty situation per conversation, the first in order."""
    return rows.filter(F.trim(F.coalesce("situation", F.lit(""))) != "").groupBy(*keys).agg(F.min_by("situation", order).alias("situation"))


def inventory_errors(inventory: DataFrame, label: str = "label") -> DataFrame:
    """Empty or duplicate labels of the inventory."""
    blank = inventory.filter(F.trim(F.coalesce(F.col(label).cast("string"), F.lit(""))) == "").select(F.col(label).cast("string").alias("key"), F.lit("empty_label").alias("rule"))
    dup = inventory.groupBy(label).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col(label).cast("string").alias("key"), F.lit("duplicate_label").alias("rule"))
    return blank.unionByName(dup)


def annotator_errors(votes: DataFrame, turns: DataFrame) -> DataFrame:
    """Repeated turns per annotator, turns an annotator lacks, annotation errors, and empty values.

    votes: annotator, conv_id, turn, label, confidence, error.  turns: conv_id, turn.
    """
    cols = lambda df, rule: df.select("annotator", "conv_id", "turn", F.lit(rule).alias("rule"))
    dup = votes.groupBy("annotator", "conv_id", "turn").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    names = small_side(votes.select("annotator").distinct(), 100_000)  # annotators, a checked handful
    want = turns.select("conv_id", "turn").join(names, F.lit(True))
    lacks = want.join(votes.select("annotator", "conv_id", "turn"), ["annotator", "conv_id", "turn"], "left_anti")
    flawed = votes.filter("error is not null")
    empty = votes.filter(F.col("error").isNull() & ((F.trim(F.coalesce(F.col("label").cast("string"), F.lit(""))) == "") | F.col("confidence").isNull()))
    return reduce(lambda a, b: a.unionByName(b), [cols(dup, "duplicate_turn"), cols(lacks, "missing_turn"), cols(flawed, "annotation_error"), cols(empty, "empty_value")])


# ---- S16: evaluation sources ------------------------------------------------------------------------------

EXAMPLE_COLUMNS = ["example", "conv_id", "turn", "situation", "history", "reference", "target_speaker"]


def _example(df: DataFrame, fallback_id: Column) -> DataFrame:
    return df.withColumn("example", F.coalesce(F.nullif(F.col("example"), F.lit("")), fallback_id)).select(*EXAMPLE_COLUMNS)


def _content_id() -> Column:
    return stable_id("ed", F.col("situation"), F.to_json("history"), F.col("reference"))


def from_context_lists(rows: DataFrame) -> DataFrame:
    """Rows with a list of context texts and a target; roles alternate from A."""
    texts = F.filter(F.transform("context", lambda t: X.clean(t)), lambda t: t != "")
    hist = F.transform(texts, lambda t, i: F.struct(F.when(i % 2 == 0, "A").otherwise("B").alias("role"), t.alias("text")))
    base = rows.select(F.col("id").cast("string").alias("example"), X.clean(F.col("situation")).alias("situation"), hist.alias("history"), X.clean(F.col("target")).alias("reference"))
    base = base.filter((F.size("history") > 0) & (F.col("reference") != ""))
    out = base.withColumns({"conv_id": stable_id("dialogue", F.col("situation"), F.to_json(F.slice("history", 1, 1))), "turn": (F.size("history") + 1).cast("long"),
                            "target_speaker": F.when(F.size("history") % 2 == 0, "A").otherwise("B")})
    return _example(out, _content_id())


def from_turn_rows(turns: DataFrame, offset: int = 1) -> DataFrame:
    """Turn rows (conv_id, turn, role, text, situation): every B turn with earlier text becomes an example."""
    from ..operators import sequence as seq

    cleaned = turns.withColumn("text", X.clean(F.col("text")))
    cand = seq.context_candidates(cleaned, ["conv_id"], "turn").filter("role = 'B'")
    hist = F.transform("history", lambda h: F.struct(h["role"].alias("role"), h["text"].alias("text")))
    out = cand.select(F.concat(F.col("conv_id").cast("string"), F.lit("_turn_"), (F.col("turn") + offset).cast("string")).alias("example"),
                      F.col("conv_id").cast("string").alias("conv_id"), (F.col("turn") + offset).alias("turn"), X.clean(F.col("situation")).alias("situation"),
                      hist.alias("history"), F.col("text").alias("reference"), F.lit("B").alias("target_speaker"))
    return _example(out, _content_id())


def from_context_texts(rows: DataFrame) -> DataFrame:
    """Rows with a context text of `A: ...` lines and a response; only B targets."""
    hist = X.parse_history(F.col("context"))
    base = rows.select(F.concat(F.col("conv_id").cast("string"), F.lit("_turn_"), (F.col("turn") + 1).cast("string")).alias("example"),
                       F.col("conv_id").cast("string").alias("conv_id"), (F.col("turn") + 1).alias("turn"), X.clean(F.col("situation")).alias("situation"),
                       hist.alias("history"), X.clean(F.col("response")).alias("reference"), F.coalesce("next_role", F.lit("B")).alias("target_speaker"))
    return _example(base.filter((F.size("history") > 0) & (F.col("reference") != "") & (F.col("target_speaker") == "B")), _content_id())


def read_turn_csv(spark: SparkSession, path: str) -> DataFrame:
    """Turn CSV (conv_id, utterance_idx, prompt, utterance): odd indexes are A, even ones B."""
    schema = "conv_id string, utterance_idx long, speaker_idx string, prompt string, utterance string"
    raw = splits.read_csv(spark, path, schema)
    return raw.select("conv_id", F.col("utterance_idx").alias("turn"), F.when(F.col("utterance_idx") % 2 == 1, "A").otherwise("B").alias("role"),
                      F.col("utterance").alias("text"), F.col("prompt").alias("situation"))


def evaluation_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """All sources in one table with an ingest order for `sequence.first_by_content`."""
    tagged = [f.withColumn("source", F.lit(i)) for i, f in enumerate(frames)]
    out = reduce(lambda a, b: a.unionByName(b), tagged)
    content = X.content_key(F.col("situation"), F.col("history"), F.col("reference"))
    return out.withColumns({"content": content, "ord": F.struct("source", "example", F.to_json("history"))})


def item_rows(votes: DataFrame) -> DataFrame:
    """Votes with the item key of this library."""
    return votes.withColumn("item", item_key(F.col("split"), F.col("conv_id"), F.col("turn")))
