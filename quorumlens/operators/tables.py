"""Result tables over runs, seeds and metrics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranking
from ..functions import text as X
from . import textmetrics as TM


def finite(c: Column) -> Column:
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), c)


def over_seeds(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """B1: mean, population and sample deviation of the finite values; the sample form is 0 for one value."""
    v = finite(F.col(value).cast("double"))
    return rows.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std_pop"),
        F.when(F.count(v) == 1, 0.0).otherwise(F.stddev_samp(v)).alias("std_sample"))


def seed_summary(rows: DataFrame, keys: Sequence[str], response: str) -> DataFrame:
    """B2: per (method, seed) word statistics with an exact median, flag rates and distinct-2."""
    t = TM.text_columns(rows, response).withColumn("w", X.words_by_space(F.col(response)))
    flags = X.length_flags(F.col("w"))
    rate = lambda c: F.avg(c.cast("double"))
    agg = t.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("w").alias("mean_words"), F.when(F.count("w") == 1, 0.0).otherwise(F.stddev_samp("w")).alias("std_words"),
        F.min("w").alias("min_words"), F.max("w").alias("max_words"), *[rate(c).alias(k + "_rate") for k, c in flags.items()],
        rate(X.generic_rules_b(F.col(response))).alias("generic_rate"),
        rate(X.repetition_rules_a(F.col(response), F.col("toks"), F.col("tri"))).alias("repetition_rate"))
    med = ranking.median_of(t.select(*keys, "w"), keys, "w", 16.0, "median_words")
    return TM.join_all([agg, med, TM.distinct_n(rows, keys, response, 2)], keys)


def flatten_metrics(trees: DataFrame, keys: Sequence[str], json_col: str) -> DataFrame:
    """JSON objects to (keys, path, value, text) with dotted paths, at any depth; text holds what is no number.

    One level is unfolded at a time as a map of raw JSON, so keys need not be known beforehand, until no object is left.
    """
    level = trees.select(*keys, F.lit("").alias("path"), F.col(json_col).alias("v"))
    done = []
    while True:
        entry = F.explode(F.from_json("v", "map<string,string>")).alias("k", "x")
        opened = level.select(*keys, "path", entry)
        path = F.when(F.col("path") == "", F.col("k")).otherwise(F.concat("path", F.lit("."), "k"))
        opened = opened.select(*keys, path.alias("path"), F.col("x").alias("v"))
        nested = F.startswith("v", F.lit("{"))
        number = F.col("v").try_cast("double")
        done.append(opened.filter(~nested).select(*keys, "path", number.alias("value"), F.when(number.isNull(), F.col("v")).alias("text")))
        level = opened.filter(nested)
        if level.isEmpty():
            break
    return reduce(lambda a, b: a.unionByName(b), done)


def wide_rows(long: DataFrame, keys: Sequence[str], paths: Sequence[str]) -> DataFrame:
    """One row per run with a column per path (given, so no scan to discover them)."""
    return long.groupBy(*keys).agg(*[F.max(F.when(F.col("path") == p, F.col("value"))).alias(p.replace(".", "_")) for p in paths])


def run_rollup(long: DataFrame, run_keys: Sequence[str], split: str, block: str, metrics: Sequence[str]) -> DataFrame:
    """Metrics of one block (`<split>.<block>.<metric>`) averaged over runs with the population deviation."""
    prefix = f"{split}.{block}."
    picked = long.filter(F.startswith("path", F.lit(prefix))).withColumn("metric", F.substring(F.col("path"), len(prefix) + 1, 200))
    return over_seeds(picked.filter(F.col("metric").isin(list(metrics))), [*run_keys, "metric"], "value")


def best_variant(rows: DataFrame, keys: Sequence[str], name: str, ce: str) -> DataFrame:
    """Variant with the lowest cross-entropy per group, the first name on ties."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(name, ce), F.struct(F.round(ce, 12), name)).alias("b")).select(*keys, "b.*")


def best_per_metric(rows: DataFrame, higher: Sequence[str], tol: float = 1e-12) -> DataFrame:
    """Rows whose value is within 1e-12 of the best of their metric, by the metric's direction."""
    signed = F.when(F.col("metric").isin(list(higher)), F.col("value")).otherwise(-F.col("value"))
    best = rows.groupBy("metric").agg(F.max(finite(signed)).alias("_b"))
    return rows.join(F.broadcast(best), "metric").filter(F.abs(signed - F.col("_b")) <= tol).drop("_b")  # one row per metric


def best_deployable(rows: DataFrame, higher: Sequence[str], status: str = "status") -> DataFrame:
    """Best deployable system per metric, the first name on ties."""
    signed = F.when(F.col("metric").isin(list(higher)), -F.col("value")).otherwise(F.col("value"))
    ok = rows.filter((F.col(status) == "deployable") & F.col("value").isNotNull())
    return ok.groupBy("metric").agg(F.min_by("system", F.struct(signed, "system")).alias("system"))


def reproduction_check(observed: DataFrame, expected: DataFrame, keys: Sequence[str], tol: float = 0.01) -> DataFrame:
    """Absolute difference to the expected value and whether it is within the tolerance."""
    j = expected.join(observed, list(keys), "left")
    d = F.abs(F.col("observed") - F.col("expected"))
    return j.select(*keys, "expected", "observed", d.alias("difference"), F.coalesce(d <= tol, F.lit(False)).alias("within"))


def side_by_side(runs: dict[str, DataFrame], keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per key with the metrics of every run next to each other."""
    stacked = reduce(lambda a, b: a.unionByName(b), [f.select(*keys, *metrics, F.lit(n).alias("run")) for n, f in runs.items()])
    cells = [F.max(F.when(F.col("run") == n, F.col(m))).alias(f"{n}_{m}") for n in runs for m in metrics]
    return stacked.groupBy(*keys).agg(*cells)


def registry(blocks: dict[str, DataFrame], notes: dict[str, str]) -> DataFrame:
    """Metric rows of all experiment groups in one table with group and note."""
    parts = [f.select(F.lit(g).alias("experiment"), *f.columns, F.lit(notes.get(g, "")).alias("note")) for g, f in blocks.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def missing_runs(expected: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected runs without any result row."""
    return expected.select(*keys).distinct().join(rows.select(*keys).distinct(), list(keys), "left_anti")

