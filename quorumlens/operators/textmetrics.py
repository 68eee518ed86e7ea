"""Metrics of generated text against references, contexts and each other."""

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ranking
from ..functions import text as X
from ..functions.keys import small_side
from ..functions.lineage import checkpointed

FLOOR = 1e-9
# Tokens that a task counts at a time.
SLICE_TOKENS = 500_000


def _overlap_udf(upto: int):
    """Arrow UDF of two token arrays: a struct of o1..,h1..,r1.., the clipped overlap and the totals of every order.

    Tokens of a batch are numbered; an n-gram of a text is the number of its first n - 1 tokens, which names the row as well, and its last
    token, so n-grams are never built as texts and the counts are exact.  Some rows at a time, so the arrays stay small.
    """
    names = [f"{c}{n}" for n in range(1, upto + 1) for c in "ohr"]
    kind = T.StructType([T.StructField(c, T.LongType()) for c in names])
    most = SLICE_TOKENS

    def counted(left: pa.Array, right: pa.Array) -> list[np.ndarray]:
        n = len(left)
        sizes = np.concatenate([pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in (left, right)])
        code = pa.concat_arrays([pc.list_flatten(left), pc.list_flatten(right)]).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        side = np.repeat(np.arange(2 * n), sizes)  # rows of the left side, then of the right one
        words, at, gram, out = int(code.max(initial=0)) + 1, np.arange(len(code)), side % max(n, 1), []
        for order in range(upto):
            at, gram = (at, gram) if order == 0 else (x[(at + order < len(code)) & (side[np.minimum(at + order, len(code) - 1)] == side[at])] for x in (at, gram))
            _, first, gram = np.unique(gram * words + code[at + order], return_index=True, return_inverse=True)
            mine = side[at] < n
            hyp, ref = np.bincount(gram[mine], minlength=len(first)), np.bincount(gram[~mine], minlength=len(first))
            row = side[at][first] % max(n, 1)
            out += [np.bincount(row, x, n).astype(np.int64) for x in (np.minimum(hyp, ref), hyp, ref)]
        return out

    @F.arrow_udf(kind)
    def overlaps(left: pa.Array, right: pa.Array) -> pa.Array:
        load = np.cumsum(sum(pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (left, right)))
        cuts = np.flatnonzero(np.diff(load // most)) + 1 if len(load) else load
        edges = [0, *cuts.tolist(), len(left)]
        parts = [counted(left.slice(a, b - a), right.slice(a, b - a)) for a, b in zip(edges, edges[1:])]
        return pa.StructArray.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=names)

    return overlaps


def _gram_counts_udf(upto: int):
    """Arrow UDF of a token array: (n, at, c) for each different n-gram, its first place from 1 and its count."""
    kind = T.ArrayType(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("c", T.LongType())]))
    most = SLICE_TOKENS

    def counted(texts: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False)
        code = pc.list_flatten(texts).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row, begin = np.repeat(np.arange(len(texts)), sizes), np.concatenate([[0], np.cumsum(sizes)])
        words, at, gram, found = int(code.max(initial=0)) + 1, np.arange(len(code)), row, []
        for order in range(upto):
            at, gram = (at, gram) if order == 0 else (x[(at + order < len(code)) & (row[np.minimum(at + order, len(code) - 1)] == row[at])] for x in (at, gram))
            _, first, gram = np.unique(gram * words + code[at + order], return_index=True, return_inverse=True)
            found.append((np.full(len(first), order + 1), at[first], np.bincount(gram, minlength=len(first))))
        n, place, c = (np.concatenate(x) for x in zip(*found, strict=True))
        by_row = np.argsort(row[place], kind="stable")
        n, place, c = n[by_row], place[by_row], c[by_row]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row[place], minlength=len(texts)))])
        values = [pa.array(n, pa.int32()), pa.array(place - begin[row[place]] + 1, pa.int32()), pa.array(c, pa.int64())]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(values, names=["n", "at", "c"]))

    @F.arrow_udf(kind)
    def counts(texts: pa.Array) -> pa.Array:
        load = np.cumsum(pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        edges = [0, *(np.flatnonzero(np.diff(load // most)) + 1).tolist(), len(texts)]
        return pa.concat_arrays([counted(texts.slice(a, b - a)) for a, b in zip(edges, edges[1:])])

    return counts


def _stat_names(upto: int) -> list[str]:
    return [f"{c}{n}" for n in range(1, upto + 1) for c in "ohr"]


def _split_by_id(rows: DataFrame, *ids: str) -> tuple[DataFrame, DataFrame]:
    """Rows that have their id for themselves, and rows that share it (null is an id); only ids are shuffled, unless many are shared."""
    named = [F.col(c).alias(f"_shared_{c}") for c in ids]
    shared = checkpointed(rows.groupBy(*ids).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*named))
    few, same = small_side(shared), reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_shared_{c}")) for c in ids])
    return rows.join(few, same, "left_anti"), rows.join(few, same, "left_semi")


def _with_overlaps(rows: DataFrame, hyp: str, ref: str, upto: int) -> DataFrame:
    """`rows` with o1..,h1..,r1.. of their own two texts, counted in the row."""
    counted = rows.withColumn("_o", _overlap_udf(upto)(X.tokens(F.col(hyp)), X.tokens(F.col(ref))))
    return counted.select(*rows.columns, *[F.col(f"_o.{c}").alias(c) for c in _stat_names(upto)])


def _shared_stats(pairs: DataFrame, row_id: str, hyp: str, ref: str, upto: int) -> DataFrame:
    """`gram_stats` of ids with any number of rows, over rows of n-grams: no task holds an id whole."""
    placed = pairs.select(row_id, hyp, ref).repartition(row_id)
    sides = placed.select(
        row_id, F.explode(F.array(F.struct(F.lit(1).alias("h"), F.col(hyp).alias("t")),
                                  F.struct(F.lit(0).alias("h"), F.col(ref).alias("t")))).alias("s"),
    ).select(row_id, F.col("s.h").alias("h"), X.tokens(F.col("s.t")).alias("toks"))
    rows = sides.select(row_id, "h", X.gram_rows(F.col("toks"), upto).alias("g"))
    orders = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), X.gram("g", n).alias("gram")) for n in range(1, upto + 1)]))
    grams = rows.select(row_id, "h", orders.alias("x")).select(row_id, "h", "x.n", "x.gram").filter("gram is not null")
    counted = grams.groupBy(row_id, "n", "gram").agg(
        F.sum("h").alias("hc"), F.sum(1 - F.col("h")).alias("rc")
    )
    sums = []
    for n in range(1, upto + 1):
        here = F.col("n") == n
        sums += [
            F.sum(F.when(here, F.least("hc", "rc")).otherwise(0)).alias(f"o{n}"),
            F.sum(F.when(here, F.col("hc")).otherwise(0)).alias(f"h{n}"),
            F.sum(F.when(here, F.col("rc")).otherwise(0)).alias(f"r{n}"),
        ]
    return counted.groupBy(row_id).agg(*sums)


def gram_stats(pairs: DataFrame, row_id: str, hyp: str, ref: str, upto: int = 4) -> DataFrame:
    """Per row id and order n: clipped overlap, hypothesis total and reference total, as columns o1..,h1..,r1..

    An id of one row is counted inside that row, so neither its texts nor its n-grams are shuffled; the counts of ids that several rows
    share are added up before they are clipped.  Ids without any token have no row here.
    """
    own, shared = _split_by_id(pairs.select(row_id, hyp, ref), row_id)
    single = _with_overlaps(own, hyp, ref, upto).filter("h1 + r1 > 0").select(row_id, *_stat_names(upto))
    return single.unionByName(_shared_stats(shared, row_id, hyp, ref, upto))


def bleu_floored(upto: int) -> Column:
    """Geometric mean of precisions floored at 1e-9 with brevity penalty, from `gram_stats` columns."""
    logs = [F.ln(F.greatest(F.when(F.col(f"h{n}") > 0, F.col(f"o{n}") / F.col(f"h{n}")).otherwise(0.0), F.lit(FLOOR)))
            for n in range(1, upto + 1)]
    bp = F.when(F.col("h1") > F.col("r1"), 1.0).otherwise(F.exp(1 - F.col("r1") / F.col("h1")))
    return F.when(F.coalesce("h1", F.lit(0)) > 0, bp * F.exp(reduce(lambda a, b: a + b, logs) / upto)).otherwise(0.0)


def bleu_smoothed() -> Column:
    """Add-one BLEU-4; an order without n-grams has precision 1; 0 when a side is empty."""
    logs = [F.ln(F.when(F.col(f"h{n}") == 0, 1.0).otherwise((F.col(f"o{n}") + 1) / (F.col(f"h{n}") + 1))) for n in range(1, 5)]
    bp = F.when(F.col("h1") > F.col("r1"), 1.0).otherwise(F.exp(1 - F.col("r1") / F.greatest(F.col("h1"), F.lit(1))))
    value = bp * F.exp(reduce(lambda a, b: a + b, logs) / 4)
    return F.when((F.coalesce("h1", F.lit(0)) > 0) & (F.coalesce("r1", F.lit(0)) > 0), value).otherwise(0.0)


def _f1(o: Column, h: Column, r: Column) -> Column:
    return F.when((o > 0) & (h > 0) & (r > 0), 2 * (o / h) * (o / r) / (o / h + o / r)).otherwise(0.0)


def rouge_n(n: int) -> Column:
    """N-gram multiset overlap F1."""
    return _f1(F.col(f"o{n}"), F.col(f"h{n}"), F.col(f"r{n}"))


def meteor_unigram() -> Column:
    """E5: 10PR / (R + 9P)."""
    p, r = F.col("o1") / F.col("h1"), F.col("o1") / F.col("r1")
    return F.when(F.coalesce("o1", F.lit(0)) > 0, 10 * p * r / (r + 9 * p)).otherwise(0.0)


def _lcs_udf():
    """Arrow UDF for the length of the longest common subsequence of two token arrays.

    Rows of the usual table are kept as bits of one integer, 64 tokens per machine word.  Everything is
    nested, so the function travels to executors by value and needs no installed package there.
    """

    def length(a, b) -> int:
        if a is None or b is None or len(a) == 0 or len(b) == 0:
            return 0
        places: dict = {}
        for i, w in enumerate(a):
            places[w] = places.get(w, 0) | (1 << i)
        full = (1 << len(a)) - 1
        row = full
        for w in b:
            hit = row & places.get(w, 0)
            row = ((row + hit) | (row - hit)) & full
        return len(a) - row.bit_count()

    def batch(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([length(x, y) for x, y in zip(left, right)], dtype="int64")

    return F.pandas_udf(batch, "long")


def with_rouge_l(rows: DataFrame, hyp: str, ref: str, out: str = "rouge_l") -> DataFrame:
    """Longest-common-subsequence F1 over whole token arrays (Arrow batches; no built-in does this)."""
    base = rows.withColumns({"_ht": X.tokens(F.col(hyp)), "_rt": X.tokens(F.col(ref))})
    scored = base.withColumn("_l", _lcs_udf()("_ht", "_rt"))
    return scored.withColumn(out, _f1(F.col("_l"), F.size("_ht"), F.size("_rt"))).drop("_ht", "_rt", "_l")


def distinct_n(rows: DataFrame, keys: Sequence[str], text: str, n: int, out: str | None = None) -> DataFrame:
    """Distinct over total n-grams per group, in two steps so a hot group spreads over its n-grams."""
    toks = rows.select(*keys, X.tokens(F.col(text)).alias("toks"))
    grams = toks.select(*keys, X.gram_rows(F.col("toks"), n).alias("g")).select(*keys, X.gram("g", n).alias("gram"))
    counted = grams.filter("gram is not null").groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("c"))
    ratio = (F.count(F.lit(1)) / F.sum("c")).alias(out or f"distinct_{n}")
    return counted.groupBy(*keys).agg(ratio)


def self_bleu(
    rows: DataFrame, keys: Sequence[str], row_id: str, text: str, sample: int | None, upto: int, smoothed: bool, seed: object = 0
) -> DataFrame:
    """Mean BLEU of each response against all others of its group, or of a seeded sample of `sample` of them.

    Against all others an n-gram of a response is clipped only where it is more frequent in that response than in any other; so
    the overlap is the number of n-grams less, for each n-gram whose largest count one response alone has, the distance
    to the second largest count.  Both come from aggregates that combine: rows per (n-gram, count), then the two largest counts per
    n-gram.  The closest other length comes from the table of lengths.  No response meets another one.  The n-grams of a response
    are counted inside its row; rows that share an id are added up as rows of n-grams.
    """
    keys = list(keys)
    picked = rows.select(*keys, row_id, text)
    if sample is not None:
        picked = ranking.hash_positions(picked, keys, seed, [row_id], "_pos").filter(F.col("_pos") < sample)
    toks = picked.select(*keys, row_id, X.tokens(F.col(text)).alias("toks"))
    lengths = toks.select(*keys, row_id, F.size("toks").cast("long").alias("len"))
    usable = lengths if not smoothed else lengths.filter("len > 0")
    by_len = Window.partitionBy(*keys).orderBy("len")  # one row per length
    table = usable.groupBy(*keys, "len").agg(F.count(F.lit(1)).alias("_m"))
    near = F.array_compact(F.array(F.when(F.col("_m") > 1, F.col("len")), F.lag("len").over(by_len), F.lead("len").over(by_len)))
    table = table.withColumn("_near", near).select(
        *keys, "len", F.array_min(F.transform("_near", lambda x: F.struct(F.abs(x - F.col("len")).alias("d"), x.alias("l"))))["l"].alias("ref_len"))
    own, shared = _split_by_id(picked, *keys, row_id)
    single = own.select(*keys, row_id, X.tokens(F.col(text)).alias("toks")).select(*keys, row_id, "toks", F.explode(_gram_counts_udf(upto)("toks")).alias("x"))
    single = single.select(*keys, row_id, "x.n", F.array_join(F.slice("toks", F.col("x.at"), F.col("x.n")), " ").alias("gram"), "x.c")
    grams = shared.select(*keys, row_id, X.gram_rows(X.tokens(F.col(text)), upto).alias("g"))
    orders = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), X.gram("g", n).alias("gram")) for n in range(1, upto + 1)]))
    flat = grams.select(*keys, row_id, orders.alias("x")).select(*keys, row_id, "x.n", "x.gram").filter("gram is not null")
    counted = single.unionByName(flat.groupBy(*keys, row_id, "n", "gram").agg(F.count(F.lit(1)).alias("c")))
    ties = counted.groupBy(*keys, "n", "gram", "c").agg(F.count(F.lit(1)).alias("m"), F.min(row_id).alias("row"))
    # As many entries as the n-gram has different counts.
    top = ties.groupBy(*keys, "n", "gram").agg(F.slice(F.sort_array(F.collect_list(F.struct("c", "m", "row")), False), 1, 2).alias("t"))
    first, second = F.get("t", F.lit(0)), F.get("t", F.lit(1))
    lost = top.filter(first["m"] == 1).select(*keys, first["row"].alias(row_id), "n", (first["c"] - F.coalesce(second["c"], F.lit(0))).alias("d"))
    stats = lost.groupBy(*keys, row_id).agg(*[F.sum(F.when(F.col("n") == n, F.col("d")).otherwise(0)).alias(f"d{n}") for n in range(1, upto + 1)])
    scored = usable.join(table, [*keys, "len"]).join(stats, [*keys, row_id], "left").withColumn("r1", F.col("ref_len"))
    for n in range(1, upto + 1):
        scored = scored.withColumn(f"h{n}", F.greatest(F.col("len") - (n - 1), F.lit(0))).withColumn(f"o{n}", F.col(f"h{n}") - F.coalesce(f"d{n}", F.lit(0)))
    score = bleu_smoothed() if smoothed else bleu_floored(upto)
    score = F.when(F.col("ref_len").isNull(), 0.0).otherwise(score)
    total = picked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    summed = scored.groupBy(*keys).agg(F.sum(score).alias("_s"))
    mean = F.when(F.col("_n") > 1, F.coalesce("_s", F.lit(0.0)) / F.col("_n")).otherwise(0.0)
    return total.join(summed, keys, "left").select(*keys, mean.alias("self_bleu"))


def text_columns(rows: DataFrame, response: str, context: str | None = None, reference: str | None = None) -> DataFrame:
    """Token, bigram and trigram columns used by the blocks below, computed once per row."""
    out = rows.withColumn("toks", X.tokens(F.col(response)))
    if context:
        out = out.withColumn("ctx_toks", X.tokens(F.col(context)))
    if reference:
        out = out.withColumn("ref_toks", X.tokens(F.col(reference)))
    out = out.withColumn("bi", X.bigrams(F.col("toks")))
    return out.withColumn("tri", X.trigrams(F.col("toks")))


def join_all(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, list(keys), "left"), frames)


def quality_block(rows: DataFrame, keys: Sequence[str], response: str, reference: str, context: str) -> DataFrame:
    """Per group word and character means, spread, empty rate, diversity, repetition and overlaps."""
    t = text_columns(rows, response, context, reference)
    words = F.size("toks")
    agg = t.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(words).alias("mean_words"),
        F.stddev_pop(words).alias("std_words"),
        F.avg(F.length(F.coalesce(response, F.lit("")))).alias("mean_chars"),
        F.avg((words == 0).cast("double")).alias("empty_rate"),
        F.avg(X.duplicate_rate(F.col("toks"))).alias("repeat_unigram"),
        F.avg(X.duplicate_rate(F.col("bi"))).alias("repeat_bigram"),
        F.avg(X.jaccard(F.col("toks"), F.col("ref_toks"))).alias("ref_overlap"),
        F.avg(X.jaccard(F.col("toks"), F.col("ctx_toks"))).alias("ctx_overlap"),
        F.avg(X.recall_overlap(F.col("toks"), F.col("ref_toks"))).alias("ref_recall"),
        F.avg(X.recall_overlap(F.col("toks"), F.col("ctx_toks"))).alias("ctx_recall"),
    )
    return join_all([agg, distinct_n(rows, keys, response, 1), distinct_n(rows, keys, response, 2)], keys).fillna(
        0.0, ["distinct_1", "distinct_2"]
    )


def diagnostics(rows: DataFrame, keys: Sequence[str], response: str) -> DataFrame:
    """Mean length, diversity, generic, repetition and too-short rates per group."""
    t = text_columns(rows, response)
    agg = t.groupBy(*keys).agg(
        F.avg(F.size("toks")).alias("mean_length"),
        F.avg(X.generic_rules_d(F.col(response)).cast("double")).alias("generic_rate"),
        F.avg(X.repetition_rules_d(F.col("toks")).cast("double")).alias("repetition_rate"),
        F.avg((F.size("toks") < 3).cast("double")).alias("too_short_rate"),
    )
    return join_all([agg, distinct_n(rows, keys, response, 1), distinct_n(rows, keys, response, 2)], keys).fillna(
        0.0, ["distinct_1", "distinct_2"]
    )


def per_example(rows: DataFrame, row_id: str, response: str, reference: str, context: str, min_words: int = 3) -> DataFrame:
    """One row per response with reference metrics and degeneration flags.

    Responses that share an id have the counts of all of them; one without an id has none.
    """
    own, shared = _split_by_id(rows, row_id)
    counted = _with_overlaps(own, response, reference, 4)
    counted = counted.select(*rows.columns, *[F.when(F.col(row_id).isNotNull(), F.col(c)).alias(c) for c in _stat_names(4)])
    joined = shared.join(_shared_stats(shared, row_id, response, reference, 4), row_id, "left").select(*counted.columns)
    t = text_columns(counted.unionByName(joined), response, context)
    words = F.size("toks")
    scored = t.select(
        *rows.columns,
        words.cast("long").alias("words"),
        *[bleu_floored(n).alias(f"bleu_{n}") for n in range(1, 5)],
        F.coalesce(rouge_n(1), F.lit(0.0)).alias("rouge_1"),
        F.coalesce(rouge_n(2), F.lit(0.0)).alias("rouge_2"),
        meteor_unigram().alias("meteor"),
        (words == 0).alias("empty"),
        ((words > 0) & (words < min_words)).alias("too_short"),
        X.repetition_share(F.col("bi"), F.col("tri")).alias("repetition"),
        X.generic_rules_c(F.col(response)).alias("generic"),
        X.role_leak(F.col(response)).alias("role_leak"),
        X.multi_turn_leak(F.col(response)).alias("multi_turn_leak"),
        X.copy_share(F.col("toks"), F.col("ctx_toks")).alias("copy_share"),
    )
    return with_rouge_l(scored, response, reference)


REFERENCE_METRICS = ["bleu_1", "bleu_2", "bleu_3", "bleu_4", "rouge_1", "rouge_2", "rouge_l", "meteor"]


def per_system(rows: DataFrame, scored: DataFrame, system: str, response: str, example: str) -> DataFrame:
    """Per system reference means, degeneration rates, diversity, unique ratios and duplicate ids.

    Unique counts are grouped on the text digest first, so a system with a third of all rows spreads out.
    """
    toks = X.tokens(F.col(response))
    base = rows.select(system, example, F.md5(X.match_text(F.col(response))).alias("_t"),
                       F.array_join(F.slice(toks, 1, 3), " ").alias("_s"))
    agg = scored.groupBy(system).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(m).alias(m) for m in REFERENCE_METRICS],
        *[F.avg(F.col(c).cast("double")).alias(c + "_rate") for c in ("empty", "too_short", "generic", "role_leak", "multi_turn_leak")],
        F.avg("repetition").alias("repetition_rate"),
        F.avg("copy_share").alias("copy_share"),
        F.min("words").alias("min_words"),
        F.max("words").alias("max_words"),
    )

    def distinct_share(col: str, out: str) -> DataFrame:
        per = base.filter(F.col(col) != "").groupBy(system, col).agg(F.count(F.lit(1)).alias("c"))
        return per.groupBy(system).agg((F.count(F.lit(1)) / F.sum("c")).alias(out))

    ids = base.groupBy(system, example).agg(F.count(F.lit(1)).alias("c")).groupBy(system).agg(
        F.sum(F.col("c") - 1).alias("duplicate_ids")
    )
    return join_all(
        [agg, distinct_share("_t", "unique_responses"), distinct_share("_s", "unique_starts"), ids,
         distinct_n(rows, [system], response, 1), distinct_n(rows, [system], response, 2)],
        [system],
    )
