"""K-d tree sharding: split at distributed weighted medians along the widest metadata dimension.

A node that stands for k leaves is cut so that both sides get their share of its bytes; k starts at the number of leaves, or at
what ``target_bytes`` asks for. Dimensions are whole numbers: the document id, its number of characters, and the ranks of
source and language among all values of theirs; a dimension's width is its extent in the node, as a share of that in the table.
Cuts are found by narrowing histograms: each pass sums bytes in at most BINS bins per node, and only the bins with the cut come
back, one per node. Where one value holds the cut, its rows are cut by row number, so no value, copy or source is too
large to split.

Null texts weigh as empty ones; nulls sort first in each dimension; repeated rows are rows of their own; an empty table gives
no rows. Columns other than doc_id, text, source, lang are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmill.llm.common import gapless, numbered, written

BINS = 4096
#: Metadata dimensions in order of preference among equally wide ones; the last breaks ties inside one value.
DIMENSIONS = ("_by_source", "_by_lang", "_by_id", "_by_chars")
ROW = "_row"
#: Ids beyond it count as it when widths are compared and cuts are made.
LAST = 2**61


def _ranked(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with the rank of ``column`` among its distinct values, in their order (null: -1).

    The distinct values are sorted over range partitions; a rank is a value's place in its partition and the number of values
    in those before, of which there is one row per partition. A value that many rows share is one row on its side.
    """
    values = rows.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)
    values = written(values.select(column, F.spark_partition_id().alias("_part"), (F.monotonically_increasing_id() % F.lit(1 << 33)).alias("_in")), "values")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = values.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranks = values.join(bases, "_part").select(column, (F.col("_base") + F.col("_in")).cast("long").alias(name))
    return rows.join(ranks, column, "left").withColumn(name, F.coalesce(name, F.lit(-1)))


def entries(docs: DataFrame) -> DataFrame:
    """doc_id, size (bytes + 8), crc32, the dimensions and a fixed row number of every document, written without texts."""
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    slim = written(docs.select(
        "doc_id", (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.col("source").cast("string").alias("_source"),
        F.col("lang").cast("string").alias("_lang"), F.coalesce(F.greatest(F.least(F.col("doc_id").cast("long"), F.lit(LAST)), F.lit(-LAST)), F.lit(-LAST - 1)).alias("_by_id"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("_by_chars"),
    ), "sizes")
    rows = _ranked(_ranked(slim, "_source", "_by_source"), "_lang", "_by_lang").drop("_source", "_lang")
    return written(numbered(rows).withColumn(ROW, F.col("_chunk") * 32_768 + F.col("_pos")), "entries")


class _Cut:
    """The cut of one node while it is narrowed: the cut value lies in ``low`` .. ``high``, ``wanted`` bytes above what lies below."""

    def __init__(self, dimension: str, low: int, high: int, wanted: float):
        self.dimension, self.low, self.high, self.wanted, self.tie = dimension, low, high, wanted, F.lit(True)

    def bin_(self) -> Column:
        """The row's bin in the open range, null outside of it."""
        value = F.col(self.dimension)
        inside = (value >= self.low) & (value <= self.high) & self.tie
        return F.when(inside, F.expr(f"({self.dimension} - ({self.low}L)) div {self.step()}L"))

    def step(self) -> int:
        return (self.high - self.low) // BINS + 1


class _Tree:
    """Inner nodes hold (dimension, value, row): rows above them in that order go right. A node is (first leaf, leaves)."""

    def __init__(self, leaves: int):
        self.splits: dict[tuple[int, int], tuple[str, int, int]] = {}
        self.root = (0, leaves)

    def children(self, node: tuple[int, int]) -> tuple[tuple[int, int], tuple[int, int]]:
        first, k = node
        return (first, k // 2), (first + k // 2, k - k // 2)

    def value(self, at_end, node: tuple[int, int] | None = None) -> Column:
        """``at_end(node)`` of the node where a row arrives; one condition per split."""
        node = node or self.root
        if node not in self.splits:
            return at_end(node)
        dimension, at, row = self.splits[node]
        left, right = self.children(node)
        above = (F.col(dimension) > at) | ((F.col(dimension) == at) & (F.col(ROW) > row))
        return F.when(above, self.value(at_end, right)).otherwise(self.value(at_end, left))

    def ends(self, node: tuple[int, int] | None = None) -> list[tuple[int, int]]:
        node = node or self.root
        return [x for c in self.children(node) for x in self.ends(c)] if node in self.splits else [node]


def _narrow(rows: DataFrame, tree: _Tree, cuts: dict[tuple[int, int], _Cut]) -> None:
    """Narrow all cuts to single values: a pass sums the bytes of at most BINS bins per node and brings back one bin per node."""
    none = F.struct(F.lit(None).cast("int").alias("node"), F.lit(None).cast("long").alias("bin"), F.lit(None).cast("double").alias("wanted"))
    while open_ := {k: c for k, c in cuts.items() if c.low < c.high}:

        def at_end(node, open_=open_):
            c = open_.get(node)
            return none if c is None else F.struct(F.lit(node[0]).cast("int").alias("node"), c.bin_().alias("bin"), F.lit(float(c.wanted)).alias("wanted"))

        bins = rows.select(tree.value(at_end).alias("at"), "size").groupBy("at").agg(F.sum("size").alias("w")).select("at.*", "w").filter("bin is not null")
        upto = bins.withColumn("upto", F.expr("sum(w) over (partition by node order by bin)"))
        here = F.struct("bin", "upto", "w")
        found = upto.groupBy("node").agg(F.min(F.when(F.col("upto") >= F.col("wanted"), here)).alias("at"), F.max(here).alias("last")).collect()  # one row per node
        by_first = {k[0]: c for k, c in open_.items()}
        for r in found:
            c, at = by_first[r["node"]], r["at"] or r["last"]
            c.wanted -= at["upto"] - at["w"]
            step = c.step()
            c.low, c.high = c.low + at["bin"] * step, min(c.high, c.low + (at["bin"] + 1) * step - 1)


def kd_tree(rows: DataFrame, leaves: int) -> Column:
    """The leaf 0 .. leaves - 1 of a row of ``entries``, as an expression over its dimensions."""
    tree, whole = _Tree(leaves), None
    while splitting := [n for n in tree.ends() if n[1] > 1]:
        leaf = tree.value(lambda n: F.lit(n[0])).alias("leaf")
        ranges = [f(d).alias(f"{d}{i}") for d in (*DIMENSIONS, ROW) for i, f in enumerate((F.min, F.max))]
        stats = {r["leaf"]: r for r in rows.select(leaf, "size", *DIMENSIONS, ROW).groupBy("leaf").agg(F.sum("size").alias("w"), *ranges).collect()}  # one row per node
        if whole is None:
            whole = {d: max([1, *(r[f"{d}1"] - r[f"{d}0"] for r in stats.values())]) for d in DIMENSIONS}
        cuts = {}
        for n in splitting:
            if (r := stats.get(n[0])) is None:  # nothing there: any cut will do
                tree.splits[n] = (DIMENSIONS[0], 0, 0)
                continue
            widest = max(DIMENSIONS, key=lambda d: (r[f"{d}1"] - r[f"{d}0"]) / whole[d])
            cuts[n] = _Cut(widest, r[f"{widest}0"], r[f"{widest}1"], r["w"] * (n[1] // 2) / n[1])
        _narrow(rows, tree, cuts)
        main = {n: (c.dimension, c.low) for n, c in cuts.items()}
        for n, c in cuts.items():  # inside the value that holds the cut: by row number
            c.tie, c.dimension, c.low, c.high = F.col(c.dimension) == c.low, ROW, stats[n[0]][f"{ROW}0"], stats[n[0]][f"{ROW}1"]
        _narrow(rows, tree, cuts)
        tree.splits |= {n: (*main[n], c.low) for n, c in cuts.items()}
    return tree.value(lambda n: F.lit(n[0]))


def shards(docs: DataFrame, leaves: int | None = 24, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (gapless per shard) of every document."""
    rows = entries(docs)
    if target_bytes is not None:
        leaves = max(1, -(-(rows.agg(F.sum("size")).first()[0] or 0) // target_bytes))
    placed = written(rows.withColumn("shard", kd_tree(rows, leaves).cast("int")).select("doc_id", "size", "text_crc32", "shard", "_chunk", "_pos"), "placed")
    return gapless(placed, ["shard"], "slot").select("doc_id", "size", "text_crc32", "shard", "slot")
