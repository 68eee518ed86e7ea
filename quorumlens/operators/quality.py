"""Data-quality checks (Q1-Q9).  Each rule is a query that yields error rows; an empty result means passed."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class CheckFailed(ValueError):
    """Raised by `require_empty` with a preview of the offending rows."""


def require_empty(errors: DataFrame, what: str, preview: int = 20) -> None:
    rows = errors.limit(preview).collect()  # bounded preview for the message
    if rows:
        raise CheckFailed(f"{what}: " + "; ".join(str(r.asDict()) for r in rows))


def mass_errors(rows: DataFrame, keys: Sequence[str], p: str = "p", tol: float = 1e-8) -> DataFrame:
    """Q1: groups whose probabilities do not sum to 1 within the tolerance."""
    sums = rows.groupBy(*keys).agg(F.sum(p).alias("mass"))
    return sums.withColumn("error", F.abs(F.col("mass") - 1)).filter(F.col("error") > tol)


def mass_summary(rows: DataFrame, keys: Sequence[str], p: str = "p", tol: float = 1e-8) -> DataFrame:
    """Q1: number of groups, failed groups and the largest error."""
    sums = rows.groupBy(*keys).agg(F.abs(F.sum(p) - 1).alias("error"))
    return sums.agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum((F.col("error") > tol).cast("long")).alias("failed"),
        F.max("error").alias("max_error"),
    )


def missing_keys(expected: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Q2: expected keys that are not present."""
    return expected.select(*keys).distinct().join(present.select(*keys).distinct(), list(keys), "left_anti")


def column_diff(df: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Q3: columns outside the whitelist and whitelisted columns that are absent."""
    have, want = set(df.columns), set(allowed)
    rows = [(c, "extra") for c in sorted(have - want)] + [(c, "missing") for c in sorted(want - have)]
    return df.sparkSession.createDataFrame(rows, "column_name string, problem string")


def leaked_tokens(df: DataFrame, id_col: str, tokens: Sequence[str]) -> DataFrame:
    """Q3: rows whose values contain a private token, with the token."""
    payload = F.to_json(F.struct(*[F.col(c) for c in df.columns]))
    hits = F.filter(F.array(*[F.lit(t) for t in tokens]), lambda t: F.contains(F.lower("_payload"), F.lower(t)))
    return df.withColumn("_payload", payload).select(id_col, F.explode(hits).alias("token"))


def rule_rows(df: DataFrame, rules: dict[str, Column], keys: Sequence[str]) -> DataFrame:
    """One row per broken rule: every rule is a boolean Column that is true for an error."""
    hits = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    return df.select(*keys, F.explode(hits).alias("rule"))


def duplicate_keys(df: DataFrame, keys: Sequence[str], rule: str = "duplicate") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*keys, F.lit(rule).alias("rule"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def export_errors(answers: DataFrame, samples: DataFrame, inventory: DataFrame) -> DataFrame:
    """Q4: validation of rater exports.

    answers: annotator_id, sample_id, label, confidence.  Rules: missing ids, duplicate answers, unknown
    samples, label outside the inventory, confidence outside 1..5, and annotators whose number of known
    samples differs from the sample set (so every annotator answered the same samples).
    """
    known_s = samples.select("sample_id").distinct().withColumn("_s", F.lit(True))
    known_l = inventory.select("label").distinct().withColumn("_l", F.lit(True))
    flat = answers.join(known_s, "sample_id", "left").join(known_l, "label", "left")
    per_row = rule_rows(
        flat,
        {
            "missing_id": F.col("annotator_id").isNull() | F.col("sample_id").isNull(),
            "unknown_sample": F.col("_s").isNull() & F.col("sample_id").isNotNull(),
            "unknown_label": F.col("_l").isNull(),
            "confidence_out_of_range": F.col("confidence").isNull() | ~F.col("confidence").between(1, 5),
        },
        ["annotator_id", "sample_id"],
    )
    dup = duplicate_keys(answers, ["annotator_id", "sample_id"], "duplicate_answer")
    want = samples.select("sample_id").distinct().agg(F.count(F.lit(1)).alias("_want"))
    got = flat.filter("_s").groupBy("annotator_id").agg(F.countDistinct("sample_id").alias("_got"))
    uneven = (
        got.crossJoin(F.broadcast(want)).filter("_got <> _want")  # one-row side
        .select("annotator_id", F.lit(None).cast(samples.schema["sample_id"].dataType).alias("sample_id"), F.lit("incomplete_samples").alias("rule"))
    )
    return union_all([per_row, dup, uneven])


def assignment_errors(assign: DataFrame, raters_per_item: int, tolerance: int = 1) -> DataFrame:
    """Q5: items with a wrong number of raters, raters who see a context twice, uneven loads, A/B imbalance.

    assign: item_id, context_id, comparison, rater, position_a (boolean).
    """
    wrong = assign.groupBy("item_id").agg(F.countDistinct("rater").alias("n")).filter(F.col("n") != raters_per_item)
    twice = assign.groupBy("context_id", "rater").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    loads = assign.groupBy("rater").agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") - F.min("n")).alias("spread"))
    sides = assign.select("item_id", "comparison", "position_a").distinct().groupBy("comparison").agg(
        F.abs(F.sum(F.when(F.col("position_a"), 1).otherwise(-1))).alias("spread")
    )
    return union_all([
        wrong.select(F.col("item_id").cast("string").alias("key"), F.lit("raters_per_item").alias("rule")),
        twice.select(F.concat_ws("|", "context_id", "rater").alias("key"), F.lit("repeated_context").alias("rule")),
        loads.filter(F.col("spread") > tolerance).select(F.lit("loads").alias("key"), F.lit("load_spread").alias("rule")),
        sides.filter("spread > 1").select(F.col("comparison").cast("string").alias("key"), F.lit("side_imbalance").alias("rule")),
    ])


def response_errors(items: DataFrame) -> DataFrame:
    """Q5: empty or identical responses of a pairwise item (item_id, response_a, response_b)."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    return rule_rows(
        items,
        {
            "empty_response": blank("response_a") | blank("response_b"),
            "identical_responses": ~blank("response_a") & (F.trim("response_a") == F.trim("response_b")),
        },
        ["item_id"],
    )


def package_errors(turns: DataFrame) -> DataFrame:
    """Q6: packages with fewer than two turns, turns without text or label, duplicate turns, and
    conversations used by several packages.  turns: package_id, conv_id, turn, text, label."""
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    per_turn = turns.select(
        F.col("package_id"),
        F.explode(F.array_compact(F.array(
            F.when(blank, F.lit("missing_text")), F.when(F.col("label").isNull(), F.lit("missing_label"))))).alias("rule"),
    )
    short = turns.groupBy("package_id").agg(F.countDistinct("turn").alias("n")).filter("n < 2")
    dup_turn = turns.groupBy("package_id", "turn").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    reused = turns.groupBy("conv_id").agg(
        F.countDistinct("package_id").alias("n"), F.min("package_id").alias("package_id")
    ).filter("n > 1")
    return union_all([
        per_turn,
        short.select("package_id", F.lit("too_short").alias("rule")),
        dup_turn.select("package_id", F.lit("duplicate_turn").alias("rule")),
        reused.select("package_id", F.lit("conversation_reused").alias("rule")),
    ])


def equal_n(systems: DataFrame, system: str = "system") -> DataFrame:
    """Q7: number of distinct row counts over systems; more than one means the table mixes sizes."""
    per = systems.groupBy(system).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.count(F.lit(1)).alias("systems"), F.countDistinct("n").alias("distinct_n"), F.min("n").alias("min_n"),
        F.max("n").alias("max_n"),
    ).withColumn("ok", F.col("distinct_n") <= 1)


def alignment_errors(frames: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Q8: keys that some of the named tables lack."""
    marked = [f.select(*keys).distinct().withColumn("src", F.lit(n)) for n, f in frames.items()]
    seen = union_all(marked).groupBy(*keys).agg(F.sort_array(F.collect_set("src")).alias("_in"))  # few table names
    absent = F.array_except(F.array(*[F.lit(n) for n in sorted(frames)]), F.col("_in"))
    return seen.filter(F.size("_in") < len(frames)).select(*keys, F.array_join(absent, ",").alias("absent_in"))


def sampled_set_errors(
    sample: DataFrame, public: DataFrame, rebuilt: DataFrame, size: int, strata: int, inventory_size: int, inventory: DataFrame
) -> DataFrame:
    """Q9: expected size, equal strata, unique conversations, turn >= 1, inventory size, same ids on the public
    side, and the same ids when the sample is drawn again.  sample: sample_id, conv_id, turn, stratum."""
    def one(df: DataFrame, rule: str) -> DataFrame:
        return df.select(F.col("key").cast("string").alias("key"), F.lit(rule).alias("rule"))

    n = sample.agg(F.count(F.lit(1)).alias("n"))
    per = sample.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    spread = per.agg((F.max("n") - F.min("n")).alias("d"), F.count(F.lit(1)).alias("k"))
    ids = sample.select("sample_id")
    return union_all([
        one(n.filter(F.col("n") != size).select(F.col("n").alias("key")), "size"),
        one(spread.filter((F.col("d") > 0) | (F.col("k") != strata)).select(F.col("d").alias("key")), "strata"),
        one(sample.groupBy("conv_id").count().filter("count > 1").select(F.col("conv_id").alias("key")), "conversation"),
        one(sample.filter("turn < 1").select(F.col("sample_id").alias("key")), "turn"),
        one(inventory.agg(F.countDistinct("label").alias("key")).filter(F.col("key") != inventory_size), "inventory"),
        one(ids.exceptAll(public.select("sample_id")).select(F.col("sample_id").alias("key")), "missing_in_public"),
        one(public.select("sample_id").exceptAll(ids).select(F.col("sample_id").alias("key")), "only_in_public"),
        one(ids.exceptAll(rebuilt.select("sample_id")).select(F.col("sample_id").alias("key")), "not_rebuilt"),
    ])
