"""Records of large JSON arrays and quoted CSV files, read by many tasks.

A multi-line reader gives a whole file to one task, because a task that starts in the middle doesn't know whether it is
inside a quoted text.  Here Spark's text reader cuts the files into blocks, and a first pass counts for each block what a
reader has to know of it: the parity of its quotes and, for JSON, how deep its brackets go if it starts outside and if it
starts inside a text.  Prefix sums over the blocks of a file (one row a block) say how each block starts.  A second pass
cuts the records.  What stands before the first and after the last border in a block is a part; parts are joined over blocks.

Files are opened by Spark alone, so every file system that it knows works; compressed files are one block each.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.keys import small_side
from ..functions.lineage import checkpointed

OUTSIDE = re.compile(r'\\.|"', re.S)
BRACKETS = re.compile(r"[\[\]{}]")
STATES = "file string, block long, quotes long, depth0 long, low0 long, depth1 long, low1 long, head string"
CUT = "file string, block long, at long, whole boolean, opens boolean, value string"


def _pieces(spark: SparkSession, path: str | Sequence[str], separator: str, options: dict) -> DataFrame:
    """file, block (its first byte), at (order inside a block) and value: the texts between separators."""
    rows = spark.read.options(**options).option("lineSep", separator).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                       F.monotonically_increasing_id().alias("at"), "value")


def _brackets(text: str, inside: bool) -> tuple[int, int, bool]:
    """Change of depth, least depth on the way, and whether the end is inside a text."""
    depth = low = at = 0
    for m in OUTSIDE.finditer(text):
        if m.group() == '"':
            if not inside:
                for b in BRACKETS.findall(text, at, m.start()):
                    depth += 1 if b in "[{" else -1
                    low = min(low, depth)
            inside, at = not inside, m.end()
    if not inside:
        for b in BRACKETS.findall(text, at):
            depth += 1 if b in "[{" else -1
            low = min(low, depth)
    return depth, low, inside


def _json_states(batches):
    state: dict = {}
    for pdf in batches:
        for file, block, value in zip(pdf["file"], pdf["block"], pdf["value"]):
            s = state.get((file, block))
            if s is None:
                # [inside, depth, least depth] for a start outside and inside a text; what stands before an array doesn't count.
                s = state[file, block] = [[False, 0, 0], [True, 0, 0], None]
                if block == 0:
                    value = value.lstrip("\ufeff \t\r\n")
                    start = value.find("[") + 1
                    depth = _brackets(value[:start], False)[0]
                    s[0], s[2], value = [False, depth, depth], value[:1000], value[start:]
            for h in (s[0], s[1]):
                depth, low, inside = _brackets(value + "}", h[0])
                h[0], h[1], h[2] = inside, h[1] + depth, min(h[2], h[1] + low)
    rows = [(f, b, int(s[0][0]), s[0][1], s[0][2], s[1][1], s[1][2], s[2]) for (f, b), s in state.items()]
    yield pd.DataFrame(rows, columns=[c.split()[0] for c in STATES.split(", ")])


def _csv_states(batches):
    state: dict = {}
    for pdf in batches:
        for file, block, value in zip(pdf["file"], pdf["block"], pdf["value"]):
            state[file, block] = state.get((file, block), 0) + value.count('"')
    rows = [(f, b, n % 2, 0, 0, 0, 0, None) for (f, b), n in state.items()]
    yield pd.DataFrame(rows, columns=[c.split()[0] for c in STATES.split(", ")])


def _starts(states: DataFrame, wrappers: Sequence[str]) -> DataFrame:
    """file, block, inside, depth, closed (the array ended before) and base (depth of the array; 0: no array of records)."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    s = states.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    s = s.withColumns({"_d": F.when(F.col("inside"), F.col("depth1")).otherwise(F.col("depth0")), "_l": F.when(F.col("inside"), F.col("low1")).otherwise(F.col("low0"))})
    named = "|".join(re.escape(w) for w in wrappers)
    base = F.when(F.col("head").startswith("["), 1)
    if named:
        base = base.when(F.col("head").rlike(r'^\{\s*"(' + named + r')"\s*:\s*\['), 2)
    s = s.withColumns({"depth": F.coalesce(F.sum("_d").over(before), F.lit(0)), "base": F.max(F.when(F.col("block") == 0, base.otherwise(0))).over(Window.partitionBy("file"))})
    ends = F.col("depth") + F.col("_l") < F.col("base")
    return s.select("file", "block", "inside", "depth", F.coalesce(F.max(ends).over(before), F.lit(False)).alias("closed"), "base")


def _rows(out: list) -> pd.DataFrame:
    return pd.DataFrame(out, columns=[c.split()[0] for c in CUT.split(", ")])


# Characters a task gathers before it passes records on.
PASS_CHARS = 8 << 20


def _json_cut(batches):
    """Objects of the array, and for each block its part of an object that other blocks begin or end."""
    out, chars, key = [], 0, None
    held: list = []
    last = 0

    def part():
        # Only an object that has begun is carried on.
        return [(*key, last, False, opens, "".join(held))] if key is not None and not closed and held and (depth > base or inside) else []

    for pdf in batches:
        for file, block, at, value, own_inside, own_depth, own_closed, own_base in zip(*[pdf[c] for c in ("file", "block", "at", "value", "inside", "depth", "closed", "base")]):
            if (file, block) != key:
                out += part()
                key, inside, depth, closed, base = (file, block), bool(own_inside), int(own_depth), bool(own_closed), int(own_base)
                held, opens = [], depth == base and not inside
                if block == 0:
                    value = value.lstrip("\ufeff \t\r\n")
                    start = value.find("[") + 1
                    depth, opens, value = base, True, value[start:]
            last = at
            if closed or base == 0:
                continue
            if not held and opens:
                first = value.find("{")
                start = first if first >= 0 else len(value)
                skipped, low, _ = _brackets(value[:start], False)
                if low < 0:
                    closed = True
                    continue
                depth, value = depth + skipped, value[start:]
                if first < 0:
                    # Nothing but the ends of other values before the separator.
                    closed = True
                    continue
            change, low, inside = _brackets(value + "}", inside)
            if depth + low < base:
                closed = True
                continue
            depth += change
            held.append(value + "}")
            chars += len(value)
            if depth == base and not inside:
                out.append((file, block, at, opens, opens, "".join(held)))
                held, opens = [], True
            if chars > PASS_CHARS:
                yield _rows(out)
                out, chars = [], 0
    yield _rows(out + part())


def _csv_cut(batches):
    """Lines up to an even number of quotes, and for each block its part of a record that other blocks begin or end."""
    out, chars, key = [], 0, None
    held: list = []
    last = 0

    def part():
        return [(*key, last, False, opens, "".join(held))] if key is not None and held else []

    for pdf in batches:
        for file, block, at, value, own_inside in zip(*[pdf[c] for c in ("file", "block", "at", "value", "inside")]):
            if (file, block) != key:
                out += part()
                key, inside, held = (file, block), bool(own_inside), []
                opens = not inside
            last = at
            inside ^= value.count('"') % 2 == 1
            held.append(value + "\n")
            chars += len(value)
            if not inside:
                out.append((file, block, at, opens, opens, "".join(held)))
                held, opens = [], True
            if chars > PASS_CHARS:
                yield _rows(out)
                out, chars = [], 0
    yield _rows(out + part())


def _records(spark: SparkSession, path: str | Sequence[str], separator: str, options: dict, count, cut, wrappers: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(file, block, at, value of each record; starts of the blocks)."""
    starts = checkpointed(_starts(_pieces(spark, path, separator, options).mapInPandas(count, STATES), wrappers))
    checked = small_side(starts)
    pieces = _pieces(spark, path, separator, options).join(checked, ["file", "block"])
    if checked is starts:
        # Too many blocks for a broadcast: the join has shuffled the pieces.
        pieces = pieces.repartition("file", "block")
    found = checkpointed(pieces.sortWithinPartitions("file", "block", "at").mapInPandas(cut, CUT))
    # A record that spans blocks: its first part opens it, others follow; at most two parts a block.
    parts = found.filter("NOT whole")
    number = F.sum(F.col("opens").cast("long")).over(Window.partitionBy("file").orderBy("block", "at"))
    joined = parts.withColumn("_n", number).groupBy("file", "_n").agg(F.sort_array(F.collect_list(F.struct("block", "at", "value"))).alias("p"))
    joined = joined.select("file", F.get("p", F.lit(0))["block"].alias("block"), F.get("p", F.lit(0))["at"].alias("at"), F.array_join(F.col("p.value"), "").alias("value"))
    return found.filter("whole").select("file", "block", "at", "value").unionByName(joined), starts


def read_json(spark: SparkSession, path: str | Sequence[str], schema: str, wrappers: Sequence[str] = (), whole: Callable[[list[str]], DataFrame] | None = None,
              **options: object) -> DataFrame:
    """Objects of JSON arrays as rows of `schema`, with the path of their file as _file.

    A file is an array, or an object whose first key is one of `wrappers` with an array; other files are single objects
    and are read whole, by `whole` if it is given.  Elements are objects; one that isn't valid gives nulls, as in Spark's
    reader.
    """
    found, starts = _records(spark, path, "}", options, _json_states, _json_cut, wrappers)
    rows = found.select("file", F.from_json("value", schema).alias("r")).select("r.*", F.col("file").alias("_file"))
    single = [r["file"] for r in starts.filter("base = 0").select("file").distinct().collect()]  # paths, as the driver lists them anyway
    if single:
        plain = lambda paths: spark.read.schema(schema).option("multiLine", True).json(paths).withColumn("_file", F.col("_metadata.file_path"))
        rows = rows.unionByName((whole or plain)(single))
    return rows


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str, **options: object) -> DataFrame:
    """Records of CSV files with a header and doubled quotes as rows of `schema`; line feeds inside quotes belong to the text.

    Each file may have its own order of columns; columns that its header lacks are null, others are left out.
    """
    found, _ = _records(spark, path, "\n", options, _csv_states, _csv_cut, ())
    wanted = StructType.fromDDL(schema)
    header = found.filter("block = 0").groupBy("file").agg(F.min_by("value", "at").alias("header"), F.min("at").alias("_first"))
    header = checkpointed(header.withColumn("header", F.regexp_replace("header", "^\ufeff|\r?\n$", "")))
    body = found.join(small_side(header), "file").filter("(block > 0 OR at > _first) AND trim(value) <> '' AND trim(value) <> '\n' AND trim(value) <> '\r\n'")
    types = {f.name: f.dataType.simpleString() for f in wanted.fields}
    out = None
    for r in header.select("header").distinct().collect():  # the layouts of the files
        names = [n.strip().strip('"') for n in r["header"].split(",")]
        layout = ", ".join(f"`_{i}` {types.get(n, 'string')}" for i, n in enumerate(names))
        rows = body.filter(F.col("header") == r["header"]).select(F.from_csv(F.regexp_replace("value", "\r?\n$", ""), layout, {"escape": '"', "multiLine": "true"}).alias("r"))
        rows = rows.select(*[F.col(f"r._{names.index(f.name)}").alias(f.name) if f.name in names else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted.fields])
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], wanted)
