"""Merkle manifest of a dataset: a tree of digests for each source, and one over the sources.

A leaf is the digest of a document's fields.  In a tree every `arity` consecutive nodes (the last run may be shorter, even one
node) become the digest of their concatenation, until one is left.  All digests are lowercase hex text of SHA-256.

* Places: leaves are ranked inside their source by doc_id (`ranking.range_positions`), so a source that holds a third of all rows
  is cut over many partitions, and from then on every key is (source, place): no key has more than one row.
* Sibling shift: a node of slot zero computes the indices of its run (index XOR slot for a binary tree, index plus slot
  else) and the level is joined with itself on them; the slot-zero rows emit the parents.
* Paths: from the root downwards a run hands its members the digests left and right of each, and what it got from above.  Runs, not
  leaves, are joined, so the upper part of a path is shuffled once for `arity` documents.
* `fold` recomputes the root from a leaf and its path.

The number of levels follows from the size of the largest source, so nothing but that number comes to the driver.

Nulls in any field have a digest of their own ("-"); a null source is the first source, a null doc_id the first of its source.
Rows that share source and doc_id are ordered by their leaf; repeated rows are leaves each.  An empty table gives no rows.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import range_positions
from .store import stored

ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_PATH = "array<struct<left: string, right: string>>"


def digest(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def leaf(**changed: Column) -> Column:
    """The digest of a document row; `changed` replaces fields."""
    def part(name: str) -> Column:
        value = changed.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return digest(F.concat(*[part(name) for name in FIELDS]))


def part_key(source: Column) -> Column:
    """A key without nulls whose bytewise order is that of the sources, null first."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def levels_of(size: int, arity: int) -> int:
    n = 0
    while size > 1:
        size, n = -(-size // arity), n + 1
    return n


def runs_of(nodes: DataFrame, arity: int) -> DataFrame:
    """part, run, size (of the next level), members (slot, digest, item) and the parent's digest; from part, idx, size, digest, item."""
    slots = F.sequence(F.lit(0), F.least(F.lit(arity), F.col("size") - F.col("idx")).cast("int") - 1)
    sibling = F.col("_idx").bitwiseXOR(F.col("slot")) if arity == 2 else F.col("_idx") + F.col("slot")
    asked = nodes.filter(F.col("idx") % arity == 0).select(
        "part", F.col("idx").alias("_idx"), F.explode(slots).alias("slot")).select("part", "slot", F.floor(F.col("_idx") / arity).alias("run"), sibling.cast("long").alias("idx"))
    found = asked.join(nodes, ["part", "idx"])
    runs = found.groupBy("part", "run").agg(
        F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct("slot", "digest", "item"))).alias("members"))
    return runs.select("part", "run", F.ceil(F.col("size") / arity).alias("size"), "members",
                       digest(F.array_join(F.transform("members", lambda m: m["digest"]), "")).alias("digest"))


class Tree:
    """The levels of one tree for each part; `nodes` has part, idx, size (nodes of the part), digest and a struct item, which stays with its node."""

    def __init__(self, nodes: DataFrame, arity: int) -> None:
        self.arity, self.nodes = arity, nodes
        self.height = levels_of(nodes.agg(F.max("size")).first()[0] or 0, arity)
        self.levels: list[DataFrame] = []
        top = lambda level, k: level.filter("size = 1").select("part", "digest", F.lit(k).alias("height"))
        self.tops = top(nodes, 0)
        level = nodes
        for k in range(self.height):
            runs = stored(runs_of(level.filter("size > 1"), arity))
            self.levels.append(runs)
            level = runs.select("part", F.col("run").alias("idx"), "size", "digest", F.lit(None).cast("int").alias("item"))
            self.tops = self.tops.unionByName(top(level, k + 1))

    def paths(self, above: DataFrame) -> DataFrame:
        """part, digest, item, head and path of each node; `above` has part, height, head and path of the top of each part."""
        down = None
        for k in reversed(range(self.height)):
            parents = above.filter(F.col("height") == k + 1).select("part", F.lit(0).cast("long").alias("run"), "head", "path")
            if down is not None:
                parents = parents.unionByName(down.select("part", F.col("idx").alias("run"), "head", "path"))
            joined = self.levels[k].join(parents, ["part", "run"])
            member = joined.select("part", "run", "head", "path", "members", F.explode("members").alias("m"))
            texts = lambda start, n: F.array_join(F.transform(F.slice("members", start, n), lambda m: m["digest"]), "")
            beside = F.struct(texts(F.lit(1), F.col("m.slot")).alias("left"), texts(F.col("m.slot") + 2, F.size("members") - F.col("m.slot") - 1).alias("right"))
            down = member.select("part", (F.col("run") * self.arity + F.col("m.slot")).alias("idx"), F.col("m.digest").alias("digest"),
                                 F.col("m.item").alias("item"), "head", F.concat(F.array(beside), F.col("path")).alias("path"))
        alone = self.nodes.filter("size = 1").select("part", "digest", "item").join(above.filter("height = 0").select("part", "head", "path"), "part")
        columns = ["part", "digest", "item", "head", "path"]
        return alone.select(*columns) if down is None else alone.select(*columns).unionByName(down.select(*columns))


def fold(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and the digests beside it, level by level."""
    return F.aggregate(path, start, lambda at, beside: digest(F.concat(beside["left"], at, beside["right"])))


def manifest(docs: DataFrame, checked: Column | None = None, arity: int = ARITY) -> DataFrame:
    """One row for each document: doc_id, leaf, subroot, root, path (left and right digests, from the leaf up) and checked.

    `checked` is a leaf digest to be verified against the manifest, made from the row's columns; without it the leaf itself.
    """
    rows = docs.select(part_key(F.col("source")).alias("part"), F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("digest"),
                       (leaf() if checked is None else checked).alias("checked"))
    placed = range_positions(stored(rows), ["part"], ["doc_id", "digest"], "idx", "size")
    sources = Tree(stored(placed.select("part", "idx", "size", "digest", F.struct("doc_id", "checked").alias("item"))), arity)
    tops = range_positions(stored(sources.tops), [], ["part"], "idx", "size")
    whole = Tree(stored(tops.select(F.lit("").alias("part"), "idx", "size", "digest", F.struct("part", "height").alias("item"))), arity)
    root = whole.tops.select("part", "height", F.col("digest").alias("head"), F.array().cast(NO_PATH).alias("path"))
    above = stored(whole.paths(root).select(
        "item.part", "item.height", F.struct(F.col("digest").alias("subroot"), F.col("head").alias("root")).alias("head"), "path"))
    found = sources.paths(above)
    return found.select("item.doc_id", F.col("digest").alias("leaf"), "head.subroot", "head.root", "path", "item.checked")


def lowered_leaf() -> Column:
    """The leaf of a row whose text was tampered with: A-Z in lower case."""
    return leaf(text=F.translate(F.col("text").cast("string"), UPPER, LOWER))


def verify(docs: DataFrame, tampered: Column, arity: int = ARITY) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified, when the rows that `tampered` names arrive with A-Z lower-cased.

    A row for which `tampered` is null arrives as it was.
    """
    found = manifest(docs, F.when(tampered, lowered_leaf()).otherwise(leaf()), arity)
    proof = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
    found = found.select("doc_id", "leaf", "subroot", "root", digest(proof).alias("proof_sha256"), fold(F.col("checked"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
