"""Writers and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranking
from ..functions import text as X

# Keys that must not appear in the text-free export.
FORBIDDEN = ["utterance", "text", "situation", "prompt", "context", "response"]


def wide_matrix(long: DataFrame, row: str, column: str, value: str, columns: Sequence[object]) -> DataFrame:
    """Rows x columns pivot with the column values given (no scan to discover them); empty cells are 0."""
    return long.groupBy(row).pivot(column, list(columns)).agg(F.first(value)).fillna(0.0)


def write_matrix(wide: DataFrame, path: str) -> None:
    wide.write.mode("overwrite").option("header", True).csv(path)


def metadata_turns(votes: DataFrame) -> DataFrame:
    """Text-free rows of turns: annotator, split, conversation, turn, speaker, label, code, confidence; label and code may be null."""
    # UTF-32 with the leading byte-order mark dropped: eight hex digits per character.
    hexed = F.regexp_replace(F.hex(F.encode(F.col("label").cast("string"), "UTF-32")), "^0000FEFF", "")
    points = F.regexp_extract_all(hexed, F.lit("([0-9A-F]{8})"), F.lit(1))
    code = F.array_join(F.transform(points, lambda p: F.concat(F.lit("U+"), F.regexp_replace(p, "^0{1,4}", ""))), " ")
    return votes.select(
        "annotator", "split", "conv_id", "turn", F.col("role").alias("speaker"), "label", code.alias("unicode"), "confidence")


def forbidden_columns(df: DataFrame) -> list[str]:
    """Forbidden keys anywhere in the schema, nested ones included."""
    found: set[str] = set()

    def visit(t) -> None:
        for f in getattr(t, "fields", []):
            found.add(f.name)
            visit(f.dataType)
        for part in ("elementType", "valueType"):
            if hasattr(t, part):
                visit(getattr(t, part))

    visit(df.schema)
    return sorted(found & set(FORBIDDEN))


def metadata_records(turns: DataFrame) -> DataFrame:
    """One JSON line per (annotator, split, conversation) with its labelled turns in order; the list may be empty."""
    entry = F.when(F.col("label").isNotNull(), F.struct("turn", "speaker", "label", "unicode", "confidence"))
    rec = turns.groupBy("annotator", "split", "conv_id").agg(F.sort_array(F.collect_list(entry)).alias("turn_annotations"))  # one conversation
    return rec.withColumn("line", F.to_json(F.struct(F.col("conv_id").alias("dialogue_id"), "split", "turn_annotations")))


def write_metadata(records: DataFrame, path: str) -> None:
    """Gzip JSON lines, one folder per annotator and split."""
    bad = forbidden_columns(records.drop("line"))
    if bad:
        raise ValueError(f"text-bearing columns in the export: {bad}")
    records.select("annotator", "split", F.col("line").alias("value")).write.mode("overwrite").partitionBy("annotator", "split").option(
        "compression", "gzip").text(path)


def manifest(records: DataFrame) -> DataFrame:
    """Conversations and a content digest per (annotator, split).

    The digest is order-free and associative: the sum of line digests (as decimals of 15 hex digits each), so a
    file of any size is never gathered.
    """
    part = lambda i: F.conv(F.substring(F.sha2("line", 256), i, 8), 16, 10).cast("decimal(38,0)")
    sums = [F.sum(part(1 + 8 * k)).alias(f"_{k}") for k in range(4)]
    agg = records.groupBy("annotator", "split").agg(F.count(F.lit(1)).alias("conversations"), *sums)
    return agg.select("annotator", "split", "conversations", F.sha2(F.concat_ws("|", *[F.col(f"_{k}").cast("string") for k in range(4)]), 256).alias("content_sha256"))


def source_turns(rows: DataFrame) -> DataFrame:
    """Dense turn numbers by utterance index, and speaker letters by first appearance.

    rows: conv_id, utterance_idx, speaker_idx, utterance, prompt.
    """
    placed = ranking.positions(rows, ["conv_id"], ["utterance_idx"], F.floor(F.col("utterance_idx") / ranking.BLOCK), "turn")
    seen = rows.groupBy("conv_id", "speaker_idx").agg(F.min("utterance_idx").alias("_f"))
    letters = seen.withColumn("speaker", F.char(F.lit(64) + F.row_number().over(Window.partitionBy("conv_id").orderBy("_f"))))  # speakers of one conversation
    return placed.join(letters.drop("_f"), ["conv_id", "speaker_idx"]).select(
        "conv_id", "turn", "speaker", X.clean(F.col("utterance")).alias("text"), X.clean(F.col("prompt")).alias("situation"))


def reconstructed(metadata: DataFrame, source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Metadata joined with the source turns, and the reject rows: absent conversation, turn out of range,
    speaker mismatch, turns without a label."""
    keys = ["conv_id", "turn"]
    m = metadata.select("split", *keys, F.col("speaker").alias("_sp"), "label", "confidence")
    known = source.select("conv_id").distinct().withColumn("_c", F.lit(True))
    j = m.join(known, "conv_id", "left").join(source.withColumn("_t", F.lit(True)), keys, "left")
    rule = F.when(F.col("_c").isNull(), "absent_conversation").when(F.col("_t").isNull(), "turn_out_of_range").when(
        (F.coalesce("_sp", F.lit("")) != "") & (F.col("_sp") != F.col("speaker")), "speaker_mismatch")
    checked = j.withColumn("rule", rule)
    used = m.select("conv_id").distinct()
    bare = source.join(used, "conv_id", "left_semi").join(m.select(*keys), keys, "left_anti").select(*keys, F.lit("missing_label").alias("rule"))
    rejects = checked.filter("rule is not null").select(*keys, "rule").unionByName(bare)
    good = checked.filter("rule is null").select("split", *keys, "speaker", "text", "situation", "label", "confidence")
    return good, rejects
