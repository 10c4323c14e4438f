"""What each filter of a chain removes in every order of the chain, from one pass over the documents.

Each document becomes a mask of the filters that it fails; masks are counted per part and label, and only these cells (at most
2**filters x 4 per part) are folded over all orders: SQL's ``aggregate`` walks one order, ``transform`` walks the array of
orders, which every task holds as a constant. A cell's structs (orders x steps of them) are weighted by its count and the
cells of a part are merged by sums element by element. Removals over all orders give each filter's Shapley count.

Failing E means that a smaller doc_id somewhere in the table has the same text, known by its SHA-256. The smallest id of a text comes
from sums per task and one row per text; documents meet it under (digest, doc_id), which no group of copies makes hot.

Null texts are empty, so they are copies of each other and of empty ones; a null doc_id is smaller than none and
larger than none, so it neither fails E nor makes others fail; repeated rows have the same id and aren't copies by
it. Rows without a language, or with an empty one, form the part ''. Several labels of one document count as either. An
empty table gives no rows. Only doc_id, text, lang and the labels' doc_id, quality and toxic are read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.llm.common import shielded, words, written

FILTERS = "ABCDE"
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column) -> dict[str, Column]:
    """Whether a text (not null) fails the filters that look at it alone."""
    own = words(text)
    return {
        "A": F.size(own) < 100,
        "B": 100 * F.size(F.array_distinct(own)) < 80 * F.size(own),
        "C": 100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))) > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def labelled(labels: DataFrame) -> DataFrame:
    """One row per doc_id: whether any label says quality 1, and toxic 1."""
    own, _ = shielded(labels, ("doc_id", "quality", "toxic"))
    said = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    return own.filter("doc_id is not null").groupBy("doc_id").agg(said("quality").alias("good"), said("toxic").alias("bad"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail (bit i: the i-th of FILTERS)."""
    text = F.coalesce("text", F.lit(""))
    failed = text_failures(text)
    bits = [F.when(failed[f], 1 << i).otherwise(0) for i, f in enumerate(FILTERS) if f in failed]
    slim = docs.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), sum(bits[1:], bits[0]).alias("alone"),
    )
    # equal rows are folded before anything is dealt by digest or id
    counted = written(slim.groupBy("doc_id", "part", "digest", "alone").agg(F.count(F.lit(1)).alias("rows")), "filter-masks")
    first = counted.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    masks = counted.join(first, ["digest", "doc_id"], "left").withColumn("mask", F.col("alone") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0))
    return masks.join(labelled(labels), "doc_id", "left").groupBy("part", "mask").agg(
        F.sum("rows").alias("n"), *[F.sum(F.col("rows") * F.coalesce(c, F.lit(0))).alias(name) for c, name in (("good", "good"), ("bad", "toxic"))]
    )


def orders(filters: str = FILTERS) -> list[str]:
    return ["".join(p) for p in permutations(filters)]


def _constant(values: list[str]) -> Column:
    """An array that the plan holds as one literal."""
    return F.expr("array(" + ", ".join(f"'{v}'" for v in values) + ")")


def folded(filters: str = FILTERS) -> Column:
    """One struct of MEASURES per order and step for a cell with columns mask, n, good and toxic."""
    mask, n = F.col("mask"), F.col("n")
    none = F.lit(0).cast("long")

    def step(state: Column, letter: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1), F.instr(F.lit(filters), letter) - 1)
        fails = mask.bitwiseAND(bit) != 0
        out, stays = state["alive"] & fails, state["alive"] & ~fails
        measured = F.struct(
            F.when(stays, n).otherwise(none).alias("kept"), F.when(out, n).otherwise(none).alias("removed"),
            F.when(fails & ~state["alive"], n).otherwise(none).alias("redundant"), F.when(mask == bit, n).otherwise(none).alias("unique_fails"),
            F.when(out, F.col("good")).otherwise(none).alias("good_lost"), F.when(out, F.col("toxic")).otherwise(none).alias("toxic_lost"),
        )
        return F.struct(stays.alias("alive"), F.concat(state["steps"], F.array(measured)).alias("steps"))

    nothing = F.array().cast("array<struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">>")
    start = F.struct(F.lit(True).alias("alive"), nothing.alias("steps"))
    return F.flatten(F.transform(_constant(orders(filters)), lambda order: F.aggregate(F.split(order, ""), start, step, lambda s: s["steps"])))


def audit(docs: DataFrame, labels: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order and step with MEASURES and the step's filter's Shapley count."""
    plus = lambda a, b: F.struct(*[(a[m] + b[m]).alias(m) for m in MEASURES])
    arrays = cells(docs, labels).select("part", folded(filters).alias("steps"))
    # a part has at most 2**filters cells
    summed = F.aggregate(F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0))), F.get("cells", F.lit(0)), lambda a, b: F.zip_with(a, b, plus))
    parts = arrays.groupBy("part").agg(F.collect_list("steps").alias("cells")).select("part", summed.alias("steps"))
    letters = _constant([f for order in orders(filters) for f in order])
    removed = lambda f: F.aggregate(F.zip_with("steps", letters, lambda s, x: F.when(x == f, s["removed"]).otherwise(0)), F.lit(0).cast("long"), lambda a, b: a + b)
    totals = F.map_from_arrays(F.array(*[F.lit(f) for f in filters]), F.array(*[removed(f) for f in filters]))
    names = _constant(orders(filters))
    rows = parts.select("part", totals.alias("totals"), F.posexplode("steps").alias("at", "s"))
    return rows.select(
        "part", F.get(names, F.expr(f"at div {len(filters)}")).alias("filter_order"), (F.col("at") % len(filters) + 1).cast("int").alias("step"),
        *[F.col(f"s.{m}").alias(m) for m in MEASURES], F.col("totals")[F.get(letters, F.col("at"))].alias("shapley"),
    )
