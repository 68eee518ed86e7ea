"""Line dedup with a suffix array over line ids, built by distributed prefix doubling.

A document is its sequence of lines (cut at line feeds, white space at the ends ignored, blank lines left out).  A run is
reportable if it has at least `min_words` words.  A line is deleted if it lies in a reportable run that starts earlier
elsewhere: in a smaller doc_id, or in the same document before; so from each line the longest run with an earlier start goes
whole, with trailing lines that have too few words by themselves.  Adjoining deleted lines are one maximal repeated run.

* Line ids: a hash of the line; lines that occur once end every repeated run, so only the others become suffixes.
* Doubling: suffixes are ranked by their first 1, 2, 4, ... lines.  The rank by 2h lines is the rank of the pair (rank by h
  lines, rank by h lines of the suffix h lines on).  Distinct pairs are counted before they are sorted, so a line that a
  third of all rows hold is one row there; ranks come from a range sort and the sizes of its partitions.
* Suffixes with a common prefix of a given length are one interval of the array (its inner longest-common-prefix values
  reach that length).  A window of l lines is named by two ranks of a power of two that cover it; of each interval all
  places but the first are later copies.
* Windows: from each line the shortest reportable run, and each longer one that is not reportable without its first line.
  They cover what all runs cover: take a line of a repeated run, and the last start up to that line from which the run, to
  its end, is reportable.  If that is the line, its shortest run is repeated; if not, the rest after that start is too short,
  so it is a window.  A window has at most `min_words` lines, and doubling stops there however long the copies are.

Nulls and texts without such runs stay as they are.  A document is named by its doc_id and the hash of its text: rows that
share a doc_id but not the text are documents of their own, in the order of that hash; rows alike in both are one document
and get the same result.  Rows without a doc_id come after all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stored

MIN_WORDS = 10

# What names a document, in its order.
DOC = ["doc_id", "copy"]


def _named(doc_id: Column, text: Column) -> list[Column]:
    return [F.coalesce(doc_id.cast("long"), F.lit((1 << 63) - 1)).alias("doc_id"), F.xxhash64(text.cast("string")).alias("copy")]


def _lines(text: Column) -> Column:
    """All lines, blank ones too, with their numbers and words."""
    cut = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.transform(cut, lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))


def _words(line: Column) -> Column:
    return F.when(line == "", F.lit(0)).otherwise(F.size(F.split(line, r"\s+")))


def sequences(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, copy, pos, line (its hash and length), least (lines of the shortest reportable run, 0 if there is none) and span (the line numbers of the longest window)."""
    rows = docs.select(*_named(F.col("doc_id"), F.col("text")), _lines(F.col("text").cast("string")).alias("lines"))
    kept = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("line_no"), x.alias("text"))), lambda s: s["text"] != "")
    # The walks take at most min_words lines of the run that starts in the current line; a line has a word at least.
    rows = rows.select(*DOC, kept.alias("kept")).select(
        *DOC, F.transform("kept", lambda s: _words(s["text"])).alias("words"),
        F.transform("kept", lambda s: F.struct(s["line_no"], F.xxhash64(s["text"]).alias("h"), F.length(s["text"]).alias("n"))).alias("kept"))

    def walk(start: Column, most: int) -> Column:
        """Lines, and their words, from a place on until there are min_words words."""
        return F.aggregate(
            F.slice("words", start, F.lit(most)), F.struct(F.lit(0).alias("lines"), F.lit(0).alias("words")),
            lambda acc, w: F.when(acc["words"] >= min_words, acc).otherwise(F.struct((acc["lines"] + 1).alias("lines"), (acc["words"] + w).alias("words"))))

    least = F.transform("words", lambda _, i: F.aggregate(
        F.array(walk(i + 1, min_words)), F.lit(0), lambda _, a: F.when(a["words"] >= min_words, a["lines"]).otherwise(F.lit(0))))
    # The first line and those after it that have fewer than min_words words together.
    longest = F.transform("words", lambda _, i: F.aggregate(
        F.array(walk(i + 2, min_words)), F.lit(0), lambda _, a: F.when(a["words"] >= min_words, a["lines"]).otherwise(a["lines"] + 1)))
    rows = rows.withColumn("least", least).withColumn("longest", longest)
    span = F.transform("least", lambda n, i: F.transform(
        F.slice("kept", i + 1, F.when(n == 0, F.lit(0)).otherwise(F.greatest(n, F.get("longest", i)))), lambda s: s["line_no"]))
    flat = rows.select(*DOC, F.posexplode(F.arrays_zip("kept", "least", span.alias("span"))).alias("pos", "s"))
    return flat.select(*DOC, "pos", F.struct("s.kept.h", "s.kept.n").alias("line"), F.col("s.least").alias("least"), F.col("s.span").alias("span"))


def ranked(keys: DataFrame, columns: list[str]) -> DataFrame:
    """The rank of each distinct key in their order, from 0; the rows of `keys` are distinct."""
    spark = keys.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(keys.repartitionByRange(parts, *columns).sortWithinPartitions(*columns).withColumn("_at", F.monotonically_increasing_id()))
    part, own = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each partition
    before, total = {}, 0
    for r in sorted(sizes, key=lambda r: r["part"]):
        before[r["part"]] = total
        total += r["n"]
    if not before:
        return placed.drop("_at").withColumn("rank", F.lit(0).cast("long"))
    start = F.create_map(*[F.lit(x) for k, v in before.items() for x in (k, v)])
    return placed.select(*columns, (start[part] + own).cast("long").alias("rank"))


def suffix_ranks(places: DataFrame, longest: int) -> list[DataFrame]:
    """For each k with 2**k <= longest: doc_id, copy, pos, rank by the first 2**k lines of the suffixes that share them with another."""
    first = ranked(places.groupBy("line").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("line"), ["line"])
    # Rows of one document are one here, or each level would multiply them.
    levels = [stored(places.join(first, "line").select(*DOC, "pos", "rank").dropDuplicates([*DOC, "pos"]))]
    while 2 << (len(levels) - 1) <= longest:
        h = 1 << (len(levels) - 1)
        now = levels[-1]
        on = now.select(*DOC, (F.col("pos") - h).alias("pos"), F.col("rank").alias("next"))
        paired = stored(now.withColumnRenamed("rank", "own").join(on, [*DOC, "pos"]))
        pairs = ranked(paired.groupBy("own", "next").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("own", "next"), ["own", "next"])
        levels.append(stored(paired.join(pairs, ["own", "next"]).select(*DOC, "pos", "rank")))
    return levels


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, copy and line_nos (from 0, ascending) of the lines to delete, for documents that lose any."""
    places = stored(sequences(docs, min_words))
    longest = places.agg(F.max(F.size("span"))).first()[0] or 1
    reach = F.col("reach")
    named = None
    for k, level in enumerate(suffix_ranks(places, longest)):
        # Two runs of 2**k lines, the first and the last, cover a window.
        low, high = F.greatest("least", F.lit(1 << k)), F.least(F.size("span"), F.lit((2 << k) - 1))
        windows = places.filter((F.col("least") > 0) & (low <= high)).select(*DOC, "pos", "span", low.alias("low"), high.alias("high"))
        found = windows.join(level.withColumnRenamed("rank", "a"), [*DOC, "pos"])
        found = found.select(*DOC, "pos", "span", "a", F.explode(F.sequence("low", "high")).alias("reach"))
        last = level.select(*DOC, F.col("pos").alias("last_pos"), F.col("rank").alias("b"))
        found = found.withColumn("b", F.col("a")) if k == 0 else found.withColumn("last_pos", F.col("pos") + reach - (1 << k)).join(last, [*DOC, "last_pos"])
        found = found.select(*DOC, "pos", F.slice("span", F.lit(1), reach).alias("span"), "reach", "a", "b")
        named = found if named is None else named.unionByName(found)
    named = stored(named)
    intervals = named.groupBy("reach", "a", "b").agg(F.min(F.struct(*DOC, "pos")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    later = named.join(intervals.drop("n"), ["reach", "a", "b"]).filter(F.struct(*DOC, "pos") > F.col("first"))
    return later.groupBy(*DOC).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("span")))).alias("line_nos"))


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` without the later copies of repeated runs: text, n_removed (lines) and runs, the deleted maximal runs."""
    gone = repeated_lines(docs, min_words).select(F.col("doc_id").alias("_doc_id"), F.col("copy").alias("_copy"), "line_nos")
    doc_id, copy = _named(F.col("doc_id"), F.col("text"))
    found = docs.join(gone, (doc_id == F.col("_doc_id")) & (copy == F.col("_copy")), "left").drop("_doc_id", "_copy")
    lines = F.split("text", "\n")
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "line_nos"), lambda i: F.get(lines, i)), "\n")
    after = F.transform("line_nos", lambda i: i + 1)
    runs = F.transform(F.arrays_zip(F.array_except("line_nos", after).alias("start"), F.array_except(after, F.col("line_nos")).alias("end")),
                       lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end")))
    none = F.array().cast("array<struct<start: int, end: int>>")
    return found.withColumn("text", F.when(F.col("line_nos").isNull(), F.col("text")).otherwise(kept)).withColumn(
        "n_removed", F.coalesce(F.size("line_nos"), F.lit(0)).cast("long")).withColumn(
        "runs", F.when(F.col("line_nos").isNull(), none).otherwise(runs)).drop("line_nos")
