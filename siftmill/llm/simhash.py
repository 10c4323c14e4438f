"""SimHash fingerprints, links by BK-trees over shards, and their connected components.

Texts are lower-cased in A-Z only and split at white space; every 3-word shingle, repeats included, votes with the
64 bits of its XXH64 (seed 42). Shorter texts vote as a whole; texts without words and null texts have fingerprint zero,
which is linked like any other. Empty tables give no rows; repeated rows and equal fingerprints are one class, found by
one aggregation; null document ids count as ids above all others. Other columns are not read.

Two fingerprints that differ in at most ``radius`` bits agree in one of ``radius + 1`` blocks of bits. A shard holds the
fingerprints whose block has the same hash; its BK-tree goes to every piece of the shard's fingerprints (a shard
is cut into pieces of at most PIECE fingerprints, the tree of each piece meets each later piece), and only edges within the
radius are followed. A task unites what it finds at once, so it returns at most one link per fingerprint, never all pairs.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from siftmill.llm.common import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Fingerprints of one BK-tree, and of one piece that is searched in it.
PIECE = 2048


def fingerprints(texts: list[str | None], shingle: int = 3, seed: int = 42) -> np.ndarray:
    """Unsigned 64-bit fingerprints of whole texts."""
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), dtype=np.uint64)
    for i, text in enumerate(texts):
        parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and the six blanks only
        if not parts:
            continue
        joined = b" ".join(parts)
        if len(parts) <= shingle:
            out[i] = xxh64_intdigest(joined, seed)
            continue
        ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1)
        starts = [0, *ends[:-shingle].tolist()]
        hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], dtype=np.uint64)
        ones = np.zeros(64, dtype=np.int64)
        for first in range(0, len(hashes), 65_536):
            ones += np.unpackbits(hashes[first : first + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


@F.pandas_udf(LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    """The fingerprint's bits as a signed long."""
    return pd.Series(fingerprints(texts.tolist()).view(np.int64))


class BKTree:
    """Children of a node are keyed by their integer Hamming distance to it; many probes walk down together."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.children = keys, {}
        todo = [np.arange(len(keys))] if len(keys) else []
        while todo:
            node, *_ = rest = todo.pop()
            rest = rest[1:]
            if len(rest):
                apart = np.bitwise_count(keys[rest] ^ keys[node])
                order = np.argsort(apart, kind="stable")
                edges, firsts = np.unique(apart[order], return_index=True)
                groups = np.split(rest[order], firsts[1:])
                self.children[node] = [(int(e), int(g[0])) for e, g in zip(edges, groups, strict=True)]
                todo += groups

    def within(self, probes: np.ndarray, radius: int):
        """(node, probes at most ``radius`` from it), over all nodes that have any; probes as indices."""
        todo = [(0, np.arange(len(probes)))] if len(self.keys) and len(probes) else []
        while todo:
            node, active = todo.pop()
            apart = np.bitwise_count(probes[active] ^ self.keys[node]).astype(np.int64)
            found = active[apart <= radius]
            if len(found):
                yield node, found
            for edge, child in self.children.get(node, ()):
                near = active[np.abs(apart - edge) <= radius]
                if len(near):
                    todo.append((child, near))


def _roots(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    root = parent[at]
    while (parent[root] != root).any():
        root = parent[root]
    return root


def united(keys: np.ndarray, tree: np.ndarray, probes: np.ndarray, radius: int) -> np.ndarray:
    """Place of the component of each key; ``tree`` and ``probes`` are places in ``keys``."""
    parent = np.arange(len(keys))
    for node, found in BKTree(keys[tree]).within(keys[probes], radius):
        roots = np.unique(_roots(parent, np.append(probes[found], tree[node])))
        parent[roots[1:]] = roots[0]
    return _roots(parent, np.arange(len(keys)))


def links(classes: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b) links between fingerprints ``fp``, enough that each two within ``radius`` bits are connected."""
    n = classes.count()
    width, buckets = 64 // (radius + 1), max(1, n // PIECE)
    blocks = [F.struct(F.lit(i).alias("block"), F.pmod(F.xxhash64(F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit(2**width - 1))), F.lit(buckets)).alias("bucket")) for i in range(radius + 1)]
    sharded = classes.select("fp", F.explode(F.array(*blocks)).alias("s")).select("fp", "s.*")
    sizes = sharded.groupBy("block", "bucket").agg(F.ceil(F.count(F.lit(1)) / F.lit(PIECE)).cast("int").alias("pieces"))
    sizes = written(sizes, "shards")  # written, so that the join below can split a hot shard
    # a piece meets itself and every other piece of its shard once: (i, j), i <= j
    piece = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("pieces").cast("long")).cast("int")
    dealt = sharded.join(sizes, ["block", "bucket"]).withColumn("piece", piece).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    dealt = dealt.select("fp", "block", "bucket", "piece", F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("fp", ignore_index=True)
        keys, piece, i, j = pdf["fp"].to_numpy().view(np.uint64), pdf["piece"].to_numpy(), pdf["i"].iat[0], pdf["j"].iat[0]
        root = united(keys, np.flatnonzero(piece == i), np.flatnonzero(piece == j), radius)
        linked = root != np.arange(len(keys))
        return pd.DataFrame({"a": keys[linked].view(np.int64), "b": keys[root[linked]].view(np.int64)})

    return dealt.groupBy("block", "bucket", "i", "j").applyInPandas(search, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges``; root is one node of its component.

    Large-star and small-star steps in turn until nothing changes; each step is one exchange by node and a written table.
    A node's neighbours are folded into their minimum and never gathered.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("v != u").distinct(), "edges")
    seen = _digest(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = written(both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m")), "least")
        large = written(both.filter("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct(), "edges")
        down = written(large.groupBy("v").agg(F.min("u").alias("m")), "least")
        small = large.join(down, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(down.select("v", F.col("m").alias("u")))
        edges = written(small.filter("v != u").distinct(), "edges")
        if seen == (seen := _digest(edges)):
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))


def _digest(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "u")), F.bit_xor(F.xxhash64("u", "v", F.lit(1)))).first())


def near_duplicates(docs: DataFrame, radius: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``carry``, fp, root (a fingerprint that names the class) and component_id (smallest doc_id reachable)."""
    marked = written(docs.select("doc_id", *carry, fingerprint("text").alias("fp")), "fingerprints")
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    reached = components(links(classes.select("fp"), radius))
    roots = written(classes.join(reached.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    lowest = written(roots.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    named = written(roots.join(lowest, "root").select("fp", "root", "component_id"), "named")
    return marked.join(named, "fp").select("doc_id", *carry, "fp", "root", "component_id")
